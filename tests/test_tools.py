"""Every tool of a workspace runs; a few against what is known of the smallest tables."""

import pytest

from weftgraph.operators import render
from weftgraph.plans.projection import Projection
from weftgraph.tools import Workspace


@pytest.fixture(scope="module")
def workspace(spark):
    return Workspace(Projection(spark, "/root/testdata/sf0.001"))


def test_diagrams_are_text(workspace):
    assert render.text(workspace.call_flow("ep:2")).startswith("flowchart TD\n    Client([Client])")
    assert render.text(workspace.render_dependency_map()).startswith("flowchart LR")
    assert render.text(workspace.render_component_dependency_diagram("comp:3")).startswith("flowchart LR")
    assert "<script>" in workspace.export_graph_viewer(5)


def test_questions_and_lists(workspace):
    rows = workspace.answer_architecture_question("state_lifecycle", "field1").collect()
    assert sum(r.section == "status" for r in rows) == 1
    assert workspace.list_apps().count() == 25 and set(workspace.export_architecture_docs()) == {"containers", "external_systems", "dependency_map", "apps"}
    with pytest.raises(KeyError):
        workspace.answer_architecture_question("no such family", "x")
