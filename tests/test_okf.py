"""Bundles of concepts: created, guarded, refreshed, and left alone when a write fails."""

import pytest
from pyspark.sql import functions as F

from weftgraph.sources import okf as B


def answer(spark, subject, *items, status="resolved", family="messaging_flow", request='{"channel":"a"}'):
    rows = [(family, request, subject, "consumers", i, "KAFKA") for i in items] + [(family, request, subject, "status", status, None), (family, request, subject, "subject", subject, None)]
    return spark.createDataFrame(rows, "family string, request string, subject string, section string, item string, detail string")


def statuses(df):
    return sorted(r.status for r in df.collect())


def test_concept_index_and_log(spark, tmp_path):
    root = f"file://{tmp_path}/b"
    made = B.concepts(answer(spark, "Orders Topic!", "ep:2", "ep:1"))
    assert statuses(B.write_bundle(made, root, "2024-05-01")) == ["created"]
    concepts, index, log = B.read_bundle(spark, root)
    c = concepts.first()
    assert c.path == f"investigations/messaging-flow/orders-topic-{c.key[:12]}.md" and c.description == "resolved, 2 findings"
    assert c.markdown.startswith("---\ntype: architecture-investigation\ngenerated: true\n") and c.markdown.endswith("## consumers\n\n- `ep:1` KAFKA\n- `ep:2` KAFKA\n")
    assert [r.line for r in index.collect()] == [f"- [Messaging Flow of Orders Topic!]({c.path}) - resolved, 2 findings"]
    assert [(str(r.day), r.line) for r in log.collect()] == [("2024-05-01", f"- **Creation**: Added [Messaging Flow of Orders Topic!]({c.path}).")]


def test_a_refresh_needs_leave_and_keeps_the_rest(spark, tmp_path):
    root = f"file://{tmp_path}/b"
    B.write_bundle(B.concepts(answer(spark, "a", "x")), root, "2024-05-01")
    B.write_bundle(B.concepts(answer(spark, "b", "y", request='{"channel":"b"}')), root, "2024-05-02")
    again = B.concepts(answer(spark, "a", "x", "z"))
    assert statuses(B.write_bundle(again, root, "2024-05-03")) == ["overwrite-required"]
    assert B.read_bundle(spark, root)[2].count() == 2
    assert statuses(B.write_bundle(again, root, "2024-05-03", allow_overwrite=True)) == ["updated"]
    concepts, index, log = B.read_bundle(spark, root)
    assert sorted(r.description for r in concepts.collect()) == ["resolved, 1 findings", "resolved, 2 findings"]
    assert [r.line for r in B.index_markdown(index).collect()][0] == "## Messaging flow" and index.count() == 2
    assert [str(r.day) for r in log.orderBy("place").collect()] == ["2024-05-01", "2024-05-02", "2024-05-03"]
    assert B.export_markdown(spark, root, f"file://{tmp_path}/files") == 4
    assert (tmp_path / "files/index.md").read_text().startswith("# Architecture Investigations\n\n## Messaging flow\n- [")
    assert (tmp_path / "files/log.md").read_text().splitlines()[2].startswith("2024-05-03 - **Refresh**")


def test_other_content_is_refused(spark, tmp_path):
    root = f"file://{tmp_path}/b"
    made = B.concepts(answer(spark, "a", "x"))
    B.write_bundle(made, root, "2024-05-01")
    path = made.first().path
    base = B.read_pointer(spark, root)["version"]
    for change, status in (({"generated": F.lit(False)}, "not-generated"), ({"key": F.lit("other")}, "other-key")):
        other = f"{status}-1"
        concepts, index, log = B.read_bundle(spark, root)
        concepts.withColumns(change).write.parquet(f"{root}/{other}/concepts")
        index.write.parquet(f"{root}/{other}/index")
        log.write.parquet(f"{root}/{other}/log")
        B.swap_pointer(spark, root, other, 1, "bundle")
        assert [tuple(r) for r in B.write_bundle(made, root, "2024-05-02", allow_overwrite=True).collect()] == [(path, status)]
        B.swap_pointer(spark, root, base, 1, "bundle")


def test_invalid_and_ambiguous_answers(spark, tmp_path):
    root = f"file://{tmp_path}/b"
    assert B.concepts(answer(spark, "a", "x", status="ambiguous")).count() == 0
    made = B.concepts(answer(spark, "a", "x"))
    bad = made.withColumn("markdown", F.lit("no head")).unionByName(made.withColumn("path", F.lit("../out.md"))).unionByName(made.withColumn("path", F.lit("k.md")).withColumn("key", F.lit("k")))
    assert {r.fault for r in B.faults(bad).collect()} == {"no front matter", "outside the bundle", "another semantic key"}
    assert statuses(B.write_bundle(bad, root, "2024-05-01")) == ["invalid"] * 3 and B.read_pointer(spark, root) is None


def test_a_failed_write_leaves_the_bundle(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/b"
    B.write_bundle(B.concepts(answer(spark, "a", "x")), root, "2024-05-01")
    before = B.read_pointer(spark, root)

    def fail(*_):
        raise OSError("disk full")

    monkeypatch.setattr(B, "swap_pointer", fail)
    with pytest.raises(OSError, match="disk full"):
        B.write_bundle(B.concepts(answer(spark, "b", "y", request="{}")), root, "2024-05-02")
    assert B.read_pointer(spark, root) == before and B.read_bundle(spark, root)[0].count() == 1


def test_long_sections_are_counted(spark):
    made = B.concepts(answer(spark, "a", *(f"i{k:03d}" for k in range(B.SHOWN + 7)))).first()
    assert made.markdown.count("- `") == B.SHOWN and made.markdown.endswith("- and 7 more\n")
