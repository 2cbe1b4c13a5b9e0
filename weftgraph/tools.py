"""One function per tool of the reference, over a workspace's tables.

A workspace holds the relations of `plans.projection` (or any object with the same attributes).  Tools give
DataFrames; those that draw give the lines of a diagram, which `operators.render.text` joins.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import answers, chains, diagrams, flow, linkers, lookup, metrics, policy, questions, render, rollup, scan, traverse, views
from weftgraph.sources import okf, store


class Workspace:
    """The tools, by the names that they have in the reference."""

    def __init__(self, model):
        self.model = model

    def index_workspace(self, root: str, name: str) -> str:
        """Merge nodes, drop dangling edges and store both by label; the folder that `store.load_graph` reads."""
        return store.save_graph(*store.merged(self.model.model_nodes, self.model.model_edges), root, name)

    # ---- what later tools share

    @cached_property
    def _visits(self) -> DataFrame:
        return flow.visits(self.model.entrypoints, self.model.calls, self.model.components)

    @cached_property
    def _steps(self) -> DataFrame:
        return flow.flow_steps(self._visits)

    @cached_property
    def _scored(self) -> DataFrame:
        m, c = self.model, self.model.components
        x = c.join(metrics.degrees(c, m.dependency_edges, "DEPENDS_ON"), "id").join(metrics.owned_entrypoints(c, m.entrypoints), "id").join(metrics.state_counts(c, m.accesses), "id").join(linkers.handoff_counts(m.accesses), "id", "left")
        return metrics.relevance(x.fillna(0, ["handoffs_in", "handoffs_out"]))

    @cached_property
    def _policies(self) -> DataFrame:
        return policy.policies(self.model.method_facts, self.model.components, self.model.calls)

    # ---- lookups

    def list_apps(self) -> DataFrame:
        return lookup.list_apps(self.model.apps, self.model.model_nodes)

    def find_entrypoints(self, app: str | None = None, type: str | None = None, http_method: str | None = None, path: str | None = None) -> DataFrame:
        if app:
            return lookup.find_entrypoints_in_app(self.model.entrypoints, self.model.model_edges, app, type, http_method, path)
        return scan.find_entrypoints(self.model.entrypoints, type, http_method, path)

    def find_components(self, type: str | None = None, technology: str | None = None, app: str | None = None) -> DataFrame:
        return scan.find_components(self.model.components, type, technology, app)

    def get_component_dependencies(self, component: str, depth: int = 1) -> DataFrame:
        root = scan.resolve_component(self.model.components, component).select("id")
        return traverse.dependency_closure(self.model.dependency_edges, root, depth)

    def infer_containers(self) -> DataFrame:
        return rollup.containers(self.model.components)

    def query_architecture_graph(self, label: str | None = None, filters: dict | None = None, text: str | None = None, limit: int | None = None) -> DataFrame:
        return scan.find_nodes(self.model.nodes, filters, label, text, limit)

    def trace_data_flow(self, entrypoint_id: str | None = None, name: str | None = None, param: str | None = None, sink_kind: str | None = None) -> DataFrame:
        return lookup.trace_paths(self.model.paths, self.model.entrypoints, self.model.sinks, entrypoint_id, name, param, sink_kind)

    def detect_use_cases(self) -> DataFrame:
        """entrypoint_id and the lines of its call chain."""
        return flow.call_lines(self._visits, self.model.components)

    # ---- questions

    def answer_architecture_question(self, family: str, ref: str, target: str | None = None, param: str | None = None) -> DataFrame:
        m = self.model
        ask = {
            "impact": lambda: answers.impact(m.model, m.model, m.components, ref),
            "endpoint_context": lambda: answers.endpoint_forward(m.entrypoints, ref, self._steps, m.paths, m.sinks, self._policies),
            "endpoint_context_reverse": lambda: answers.endpoint_reverse(m.components, ref, m.model_nodes, m.model_edges, m.entrypoints),
            "consumer_context": lambda: answers.consumer_context(m.entrypoints, ref, m.paths, m.sinks, self._steps),
            "transaction_context": lambda: answers.transaction_context(m.entrypoints, ref, self._steps, self._policies, m.calls, m.components),
            "scheduled_workflow": lambda: answers.scheduled_workflow(m.entrypoints, ref, self._steps, m.model_edges, m.paths, m.sinks),
            "external_integration_context": lambda: answers.external_integration(m.model_nodes, m.model_edges, ref),
            "configuration_context": lambda: answers.configuration_context(m.config, m.model_nodes, m.model_edges, ref),
            "state_lifecycle": lambda: answers.state_lifecycle(m.accesses, linkers.state_handoffs(m.accesses.where(F.contains(F.lower("field"), F.lit(ref.lower())))), ref),
            "messaging_flow": lambda: answers.messaging_flow(m.entrypoints, m.sinks, m.interfaces, m.paths, ref),
            "persistence_destination": lambda: answers.persistence_destination(m.entrypoints, ref, param, m.paths, m.sinks, m.units, m.unit_entities, m.datasources),
            "relationship": lambda: answers.relationship(m.model, m.model, ref, target or ref),
        }
        return ask[family]()

    def plan_question(self, asked: DataFrame, text_col: str = "question") -> DataFrame:
        return questions.plan(asked, text_col)

    def compile_architecture_question_to_okf(self, family: str, ref: str, bundle: str, day: str, allow_overwrite: bool = False) -> DataFrame:
        """Answer a question and add the answer to a bundle: path, status."""
        import json

        answer = self.answer_architecture_question(family, ref)
        rows = answer.select(F.lit(family).alias("family"), F.lit(json.dumps({"ref": ref}, sort_keys=True, separators=(",", ":"))).alias("request"), F.lit(ref).alias("subject"), "section", "item", "detail")
        return okf.write_bundle(okf.concepts(rows), bundle, day, allow_overwrite)

    # ---- links and chains

    def workflow_links(self) -> DataFrame:
        m = self.model
        return linkers.workflow_links(linkers.all_links(m.sinks, m.paths, m.entrypoints), m.sinks, m.paths, m.entrypoints)

    def render_pipeline(self, most: int = 20) -> DataFrame:
        links = self.workflow_links().select("from_path", "to_path")
        found = chains.without_duplicates(chains.without_prefixes(chains.chains(self.model.paths.select("id", "entrypoint_id"), links)))
        return diagrams.pipelines(chains.segments(chains.longest_per_root(found, most)))

    # ---- diagrams, exports

    def call_flow(self, entrypoint: str) -> DataFrame:
        return diagrams.call_flow(self._steps, flow.flow_edges(self._visits), self.model.components, entrypoint)

    def render_use_case_timeline(self, most: int = 20) -> DataFrame:
        return diagrams.timeline(self._steps, self.model.entrypoints, self.model.components, most)

    def render_mermaid_flowchart(self, component: str, depth: int = 1) -> DataFrame:
        edges = self.get_component_dependencies(component, depth)
        ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        return render.mermaid(self.model.components.join(ids, "id", "left_semi"), edges)

    def render_component_dependency_diagram(self, component: str, depth: int = 2) -> DataFrame:
        root = scan.resolve_component(self.model.components, component).select("id")
        edges = traverse.dependency_slice(self.model.dependency_edges, root, depth).withColumn("label", F.lit("DEPENDS_ON"))
        ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        return render.mermaid(self.model.components.join(ids, "id", "left_semi"), edges)

    def render_dependency_map(self, level: int = 3) -> DataFrame:
        return diagrams.package_map(rollup.dependency_map(self.model.components, self.model.dependency_edges, level))

    def render_source_overview(self, most: int = 10) -> DataFrame:
        return rollup.per_package(self.model.components, most)

    def render_architecture_view(self, most: int = 30, scope: str | None = None) -> DataFrame:
        return render.mermaid(*views.component_view(self._scored, self.model.model_edges, most, scope))

    def export_likec4_model(self, most: int = 30) -> DataFrame:
        picked = views.workspace(self._scored, self.model.entrypoints, self.model.model_edges, most)
        nodes = self.model.model_nodes.join(picked.select("id").distinct(), "id", "left_semi")
        return render.likec4(nodes, scan.edges_between(self.model.model_edges, nodes, views.VIEW_EDGES).where("src <> dst"))

    def export_graph_data(self) -> tuple[DataFrame, DataFrame]:
        nodes, edges = rollup.export(self.model.model_nodes, self.model.model_edges)
        return store.to_json_lines(nodes), store.to_json_lines(edges)

    def export_graph_viewer(self, most: int = 500) -> str:
        """A page of the first nodes; for people, so it is a bounded slice."""
        nodes, edges = scan.snapshot(self.model.model_nodes, self.model.model_edges, most)
        rows = [r.value for df in (nodes, edges) for r in store.to_json_lines(df).toLocalIterator()]
        return render.viewer_page("[" + ",".join(rows) + "]")

    def export_graph_architecture_poc(self) -> dict[str, DataFrame]:
        """The report's top lists."""
        m = self.model
        flags = policy.dependency_flags(m.dependency_edges, m.components)
        return {"high_signal_components": views.high_signal(self._scored), "cross_module_dependencies": views.cross_module(m.dependency_edges, flags), "labels": scan.summary(m.model_nodes)}

    def export_architecture_docs(self) -> dict[str, DataFrame]:
        m = self.model
        return {"containers": self.infer_containers(), "external_systems": views.external_systems(m.interfaces, m.entrypoints), "dependency_map": rollup.dependency_map(m.components, m.dependency_edges), "apps": self.list_apps()}
