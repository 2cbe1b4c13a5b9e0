"""Readers of XML descriptors: transaction advice, EJB transactions, resource references, data sources of an application server.

A descriptor is one row (folder, name, value) of `build_files.whole_files`; each is parsed alone, by a small
function over Arrow batches.  Files that are no XML, or declare a document type, have no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _name(e) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _below(e, name: str) -> Iterator:
    return (x for x in e.iter() if x is not e and _name(x) == name)


def _children(e, name: str) -> list:
    return [x for x in e if _name(x) == name]


def _text(e, name: str) -> str | None:
    found = _children(e, name)
    return "".join(found[0].itertext()).strip() or None if found else None


def _rows(files: DataFrame, read: Callable, schema: str) -> DataFrame:
    """read(root) -> tuples of the schema's columns after `file`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(f"file string, {schema}"))

    def run(batches):
        for b in batches:
            out = []
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text is None or "<!DOCTYPE" in text:
                    continue
                try:
                    root = ElementTree.fromstring(text.strip())
                except ElementTree.ParseError:
                    continue
                out += [(file, *r) for r in read(root)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * len(fields), fields)], schema=fields)

    return files.select(F.concat_ws("/", "folder", "name").alias("file"), "value").mapInArrow(run, f"file string, {schema}")


def read_advice(files: DataFrame) -> DataFrame:
    """file, advisor, advice, pointcut, rule, pattern, propagation, read_only, isolation: the rules of each advisor's advice, in their order."""

    def read(root):
        cuts = {e.get("id"): e.get("expression") for e in _below(root, "pointcut") if e.get("id") and e.get("expression")}
        rules = {a.get("id"): list(_below(a, "method")) for a in _below(root, "advice") if a.get("id")}
        for i, advisor in enumerate(_below(root, "advisor")):
            cut = advisor.get("pointcut") or cuts.get(advisor.get("pointcut-ref"))
            for k, m in enumerate(rules.get(advisor.get("advice-ref"), ())):
                only = m.get("read-only")
                yield i, advisor.get("advice-ref"), cut, k, m.get("name") or "*", m.get("propagation") or "REQUIRED", None if not only else only.lower() == "true", m.get("isolation") or None

    return _rows(files, read, "advisor int, advice string, pointcut string, rule int, pattern string, propagation string, read_only boolean, isolation string")


def read_ejb_transactions(files: DataFrame) -> DataFrame:
    """file, place, ejb_name, method, attribute, parameters (null if not given) of the container transactions of ejb-jar.xml files."""

    def read(root):
        for i, t in enumerate(_below(root, "container-transaction")):
            for m in _children(t, "method"):
                given = [("".join(p.itertext())).strip() for ps in _children(m, "method-params") for p in _children(ps, "method-param")]
                yield i, _text(m, "ejb-name"), _text(m, "method-name") or "*", _text(t, "trans-attribute"), given or None

    return _rows(files.where("lower(name) = 'ejb-jar.xml'"), read, "place int, ejb_name string, method string, attribute string, parameters array<string>")


def read_resource_refs(files: DataFrame) -> DataFrame:
    """file, datasource: data sources that descriptors refer to, by lookup name, mapped name or reference name."""

    def read(root):
        for r in _below(root, "resource-ref"):
            kind, found = _text(r, "res-type"), _text(r, "lookup-name") or _text(r, "mapped-name") or _text(r, "res-ref-name")
            if (kind is None or kind.endswith("DataSource")) and found:
                yield (found,)

    return _rows(files, read, "datasource string")


def read_server_datasources(files: DataFrame) -> DataFrame:
    """file, name, jndi, driver, url, unresolved: data sources of an application server's configuration; a URL without the credentials and options in it."""

    def read(root):
        for kind in ("datasource", "xa-datasource"):
            for d in _below(root, kind):
                jndi = d.get("jndi-name") or _text(d, "jndi-name")
                pool = d.get("pool-name") or d.get("name")
                if not jndi and not pool:
                    continue
                url = _text(d, "connection-url")
                if not url:
                    named = {p.get("name", "").lower(): "".join(p.itertext()).strip() for p in _below(d, "xa-datasource-property")}
                    url = named.get("url") or (f"{named['servername']}:{named.get('portnumber', '')}/{named.get('databasename', '')}" if named.get("servername") else None)
                holds = bool(url) and "${" in url
                yield pool or jndi, jndi, _text(d, "driver") or d.get("driver-name"), None if holds else url, holds

    rows = _rows(files, read, "name string, jndi string, driver string, url string, unresolved boolean")
    return rows.withColumn("url", F.regexp_replace(F.regexp_replace("url", r"//[^/@]*@", "//"), r"[?;].*$", ""))
