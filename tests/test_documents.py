import pytest
from helpers import corpus, got
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza import catalog, documents
from cadenza.errors import BadArgument, BadFormat, InvalidAnnotation, UnequalLengths, UnknownType
from cadenza.functions import identity
from cadenza.operators.validate import create, violations
from cadenza.plans.corpus import Corpus, check_columns, from_table
from cadenza.sources import codecs, load_corpus, load_lines, read_documents, read_file, read_lines, save_corpus, write_documents, write_file

GOLDEN = "d9a1b46c-38d5-56bc-aacb-0e8641382d1a"


def onset():
    return create(media_id="track:123", payload_kind="onset", extent_kind="time", time=[0.1, 0.5, 0.9], value=[1, 1, 1])


def test_golden_id(spark):
    doc = onset()
    assert doc["id"] == GOLDEN and identity.check_id(doc)
    text = identity.canonical({k: v for k, v in doc.items() if k != "id"})
    assert spark.createDataFrame([(text,)], "t string").select(identity.uuid5(F.col("t"))).first()[0] == GOLDEN
    doc["media_id"] = "track:124"
    with pytest.raises(InvalidAnnotation):
        identity.ensure_id(doc)
    assert identity.prepare_for_save(doc, validate_id=False)["id"] != GOLDEN
    assert identity.prepare_for_save(doc, False, False)["id"] == GOLDEN
    assert identity.check_id({"media_id": "a:b"}) is False


def test_create_errors():
    with pytest.raises(UnknownType):
        create(media_id="a:b", payload_kind="nothing", value=[])
    with pytest.raises(KeyError):
        create(media_id="a:b", payload_kind="beat", extent_kind="nothing", value=[1])
    with pytest.raises(BadArgument):
        create(media_id="a:b", payload_kind="beat", value=[1], more=2)
    with pytest.raises(UnequalLengths):
        create(media_id="a:b", payload_kind="beat", extent_kind="time", value=[1], time=[1.0, 2.0])
    with pytest.raises(UnknownType):
        catalog.registry_version("2.0")
    assert catalog.registry_version("1.7") == "v1"


@pytest.mark.parametrize(
    ("payload", "value", "ok"),
    [
        ("chord", "G:maj/5", True), ("chord", "H", False), ("chord", "C:maj7(*5,b9)", True), ("beat", 0, False), ("beat", 1.5, False), ("tempo", -1.0, False),
        ("key_mode", "C:minor", True), ("key_mode", "Nonsense", True), ("key_mode", "c", False), ("tag_open", 3, False), ("onset", {"x": [1]}, True), ("object", 3, False),
    ],
)
def test_values(payload, value, ok):
    doc = create(media_id="a:b", payload_kind=payload, value=[value])
    if ok:
        assert documents.validate(doc)
    else:
        with pytest.raises(InvalidAnnotation):
            documents.validate(doc)


def test_fractions():
    for bad in ([1, 0], [1, 2, 3], [1], [1.0, 2]):
        with pytest.raises(InvalidAnnotation):
            documents.validate(create(media_id="a:b", payload_kind="tag_open", extent_kind="score_quarter", value=["x"], quarter=[bad]))
    ok = create(media_id="a:b", payload_kind="tag_open", extent_kind="score_interval", value=["x", "y"], quarter=[[0, 1], [-3, 4]], duration=[[1, 2], [0, 1]])
    assert documents.validate(ok)
    with pytest.raises(InvalidAnnotation):
        documents.validate(create(media_id="a:b", payload_kind="tag_open", extent_kind="score_interval", value=["x"], quarter=[[0, 1]], duration=[[-1, 2]]))


DOCS = [
    lambda: onset(),
    lambda: create(media_id="a:b", payload_kind="object", extent_kind="time", confidence_kind="likelihood", value=[{"color": "brown"}, {"color": "white", "n": [1, 2.5, None]}], time=[0.5, 1.0], confidence=[0.25, 1.0], sandbox={"a": {"b": [1, "x"]}}),
    lambda: create(media_id="a:b", payload_kind="tag_open", extent_kind="score_interval", value=["[intro]", "(chorus)"], quarter=[[0, 1], [-3, 4]], duration=[[1, 2], [0, 1]], parents=["p"]),
    lambda: create(media_id="a:b", payload_kind="relation", performance_id="p:1", value=["007", "nan"], relation=["cover", "remix"]),
    lambda: create(media_id="a:b", payload_kind="tag_open", extent_kind="time", confidence_kind="agreement", value=["{verse}", "a,\"b\""], time=[1e-4, 1e7], confidence=[0.0, 1.0], n_annotators_common=3, n_annotators=[2, 3]),
    lambda: create(media_id="a:b", payload_kind="beat", extent_kind="time", value=[], time=[]),
]


@pytest.mark.parametrize("kind", ["json", "msgpack", "csv"])
@pytest.mark.parametrize("make", DOCS)
def test_round_trip(tmp_path, kind, make):
    doc, path = make(), str(tmp_path / f"x.{kind}")
    write_file(doc, path, kind)
    assert read_file(path, kind) == doc


def test_bad_files(tmp_path):
    for kind, data in (("json", b"{"), ("json", b"[]"), ("msgpack", b"\xc1"), ("msgpack", b"\x81\xa1a"), ("csv", b""), ("csv", b"# ---\n# x = [\n# ---\na")):
        with pytest.raises(BadFormat):
            codecs.decode(data, kind)
    doc = onset() | {"media_id": "track:5"}
    with pytest.raises(InvalidAnnotation):
        codecs.decode(codecs.to_json(doc), "json")
    assert codecs.decode(codecs.to_json(doc), "json", validate_id=False)["media_id"] == "track:5"


PLAIN = st.recursive(st.none() | st.booleans() | st.integers(-(1 << 63), (1 << 64) - 1) | st.floats(allow_nan=False) | st.text() | st.binary(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=20)


@settings(deadline=None, max_examples=60)
@given(PLAIN)
def test_msgpack(x):
    assert codecs.from_msgpack(codecs.to_msgpack(x)) == x


def test_columns():
    assert check_columns(["payload:beat:value", "extent:time:time"]) == {"payload": "beat", "extent": "time"}
    for bad in (["payload:beat"], ["payload:no:value"], ["payload:beat:no"], ["payload:beat:value", "payload:chord:value"], ["extent:time:time"]):
        with pytest.raises(InvalidAnnotation):
            check_columns(bad)
    with pytest.raises(InvalidAnnotation):
        documents.from_table(documents.to_table(onset()), {})


def test_corpus_files(spark, tmp_path):
    docs = [m() for m in DOCS[:3]]
    for i, d in enumerate(docs):
        write_file(d, str(tmp_path / f"{i}.json"))
    rows = read_documents(spark, str(tmp_path))
    assert rows.count() == 3
    c = Corpus.of_documents(rows, "object", "time", "likelihood")
    assert got(c, "extent_time") == [0.5, 1.0]
    assert c.documents().first()["id"] == docs[1]["id"]
    c = Corpus.of_documents(rows, "tag_open", "score_interval")
    assert c.documents().first()["id"] == docs[2]["id"]
    assert Corpus.of_documents(rows, "onset", "time").documents().first()["id"] == GOLDEN
    for kind in ("json", "csv", "msgpack"):
        write_documents(rows, str(tmp_path / f"out-{kind}"), kind)
    assert read_documents(spark, str(tmp_path / "out-json"), lines=True).count() == 3
    lines = read_lines(spark, str(tmp_path / "out-json"))
    assert lines.columns == rows.columns and {r["id"] for r in lines.collect()} == {d["id"] for d in docs}
    assert Corpus.of_documents(lines, "onset", "time").documents().first()["id"] == GOLDEN
    assert got(Corpus.of_documents(lines, "object", "time", "likelihood"), "payload_value")[0] == '{"color":"brown"}'
    (tmp_path / "bad").write_text('{"media_id": "a:b"}\n')
    with pytest.raises(Exception, match="no document"):
        read_lines(spark, str(tmp_path / "bad")).collect()
    save_corpus(c, str(tmp_path / "corpus"))
    back = load_corpus(spark, str(tmp_path / "corpus"), "tag_open", "score_interval")
    assert got(back, "payload_value") == ["[intro]", "(chorus)"]


def test_table_form(spark):
    c = corpus(spark, "tag_open", "time", time=[1.0, 2.0], value=["a", "b"])
    assert c.table().columns == ["annotation", "obs_index", "payload:tag_open:value", "extent:time:time"]
    assert got(from_table(c.table(), c.headers), "payload_value") == ["a", "b"]
    with pytest.raises(InvalidAnnotation):
        from_table(c.table(), c.headers.drop("media_id"))


def test_violations(spark):
    c = corpus(spark, "beat", "time", "likelihood", time=[1.0, 2.0], value=[0, 1], confidence=[0.5, 1.5])
    assert {(r["obs_index"], r["field"]) for r in violations(c).collect()} == {(0, "payload_value"), (1, "confidence_confidence")}


def test_namespaces(tmp_path):
    import json

    from cadenza.sources import namespaces

    (tmp_path / "in").write_text(json.dumps({"key": {"value": {"type": "string"}, "description": "Keys"}}))
    namespaces.translate(str(tmp_path / "in"), str(tmp_path / "out"))
    got = json.loads((tmp_path / "out").read_text())
    assert got["properties"]["values"] == {"type": "array", "description": "Keys", "items": {"type": "string"}} and got["required"] == ["payload_type", "values"]
    assert namespaces.schema_of("beat")["properties"]["value"]["items"] == {"type": "integer", "minimum": 1}
    with pytest.raises(BadFormat):
        namespaces.from_namespace({})


def test_schemas_back():
    from cadenza.sources import namespaces

    for tag, own in catalog.CATALOG["payload"].items():
        assert namespaces.from_schema(namespaces.schema_of(tag)) == (tag, own)
    pair = {"type": "array", "items": {"type": "integer"}, "minItems": 2, "maxItems": 2}
    schema = {"properties": {"payload_type": {"const": "x"}, "at": {"type": "array", "items": pair}, "one": pair}, "required": ["at"]}
    got = namespaces.from_schema(schema)[1]
    assert got["at"].kind == "fraction" and not got["at"].scalar and got["one"].scalar and got["one"].optional
    for bad in ({}, {"properties": {"payload_type": {"const": "x"}, "a": {"type": "array", "items": {"type": "null"}}}}):
        with pytest.raises(BadFormat):
            namespaces.from_schema(bad)


@pytest.mark.parametrize("make", DOCS)
def test_backends(make):
    import pandas as pd

    doc = make()
    for backend in ("pandas", "pandas-pyarrow"):
        table = documents.to_table(doc, backend)
        assert documents.from_table(table) == doc
    arrow = documents.to_table(onset(), "pandas-pyarrow")
    assert all(isinstance(t, pd.ArrowDtype) for t in arrow.dtypes)
    for bad in ("dask", *([] if has_polars() else ["polars"])):
        with pytest.raises(BadArgument):
            documents.to_table(doc, bad)
    if has_polars():
        assert documents.from_table(documents.to_table(doc, "polars"), documents.header(doc)) == doc


def has_polars() -> bool:
    from importlib.util import find_spec

    return find_spec("polars") is not None


def test_load_lines(spark, tmp_path):
    docs = [m() for m in DOCS] + [create(media_id=f"m:{k}", payload_kind="relation", performance_id=f"p:{k}", value=["a", "b"][:k], extent_kind="time", time=[0.5, 1.5][:k]) for k in range(3)]
    path = str(tmp_path / "lines")
    (tmp_path / "lines").write_text("".join(codecs.to_json(d).decode() + "\n" for d in docs))
    for kinds in (("relation", "time"), ("tag_open", "time", "agreement"), ("beat", "time"), ("object", "time", "likelihood"), ("tag_open", "score_interval"), ("chord",)):
        one, two = load_lines(spark, path, *kinds), Corpus.of_documents(read_lines(spark, path), *kinds)
        for table in ("headers", "observations"):
            a, b = getattr(one, table), getattr(two, table)
            assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_report():
    import bench

    lines = ['{"queries": {"trim_a": 1.5, "load_b": 2}, "sf": "0.1", "cpus": 8}', "", '{"queries": {"trim_a": 1.25}, "sf": "0.1", "cpus": 4}']
    got = bench.report(lines)
    assert "## trim" in got and "| trim_a | 1.500 | 1.250 |" in got and "| load_b | 2.000 |  |" in got


def test_lineage_ids(spark, tmp_path):
    """A golden parent, its trimmed child, and the child's child."""
    from cadenza.operators import filter_by, trim

    write_file(onset(), str(tmp_path / "x.json"))
    parent = Corpus.of_documents(read_documents(spark, str(tmp_path / "x.json")), "onset", "time")
    child = trim(parent, start=0.25).identified()
    head = child.headers.first()
    assert head["parents"] == [GOLDEN] and head["id"] == "3eb61db5-4dee-5926-9040-58accf92961e"
    last = filter_by(child, lambda v: v == "1").documents().first()
    assert last["parents"] == [GOLDEN, head["id"]]
