"""Registered queries of sources and sinks, identifiers, construction, checks and streams, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza import catalog, errors
from cadenza.functions import identity, scalar
from cadenza.operators import evaluate, filter_by, to_times, trim, violations
from cadenza.operators.validate import create, unequal_lengths
from cadenza.plans import adapters as A
from cadenza.plans.corpus import Corpus, check_columns, from_table
from cadenza.queries import HI, ID_JSON, LO, NAMESPACE, POINTS, SPANS
from cadenza.registry import query
from cadenza.sources import decode_documents, load_corpus, load_lines, namespaces, read_documents, read_lines, save_corpus, write_documents
from cadenza.sources.scratch import fresh
from cadenza.streaming import filter_stream, trim_stream

KIND = ("segment_open", "time_interval", "likelihood")
STORED = f"""with {SPANS} select 'order:' || annotation as media_id, obs_index, payload_value, extent_time, extent_duration, confidence_confidence from spans"""


def _with_media(corpus: Corpus) -> DataFrame:
    rows = corpus.headers.select("annotation", "media_id").join(corpus.observations, "annotation")
    return rows.select("media_id", "obs_index", *corpus.columns())


def _stored(spark: SparkSession, documents: DataFrame, kind: str, **policy) -> DataFrame:
    """Documents written in a format and read back."""
    path = fresh(spark, kind)
    write_documents(documents, path, kind, **policy)
    return read_documents(spark, path, lines=True) if kind == "json" else decode_documents(spark.read.parquet(path), kind)


@query(STORED)
def load_json_lines(spark, sf_dir):
    """JSON written as lines, read back by column expressions."""
    path = fresh(spark, "lines")
    write_documents(A.intervals(spark, sf_dir).documents(), path)
    return _with_media(Corpus.of_documents(read_lines(spark, path), *KIND))


@query(STORED)
def load_json_typed(spark, sf_dir):
    """JSON written as lines, each parsed once with the types of its kind."""
    path = fresh(spark, "lines")
    write_documents(A.intervals(spark, sf_dir).documents(), path)
    return _with_media(load_lines(spark, path, *KIND))


@query(STORED)
def load_json_checked(spark, sf_dir):
    """JSON written and read back with every document checked."""
    return _with_media(Corpus.of_documents(_stored(spark, A.intervals(spark, sf_dir).documents(), "json"), *KIND))


@query(STORED)
def load_msgpack(spark, sf_dir):
    return _with_media(Corpus.of_documents(_stored(spark, A.intervals(spark, sf_dir).documents(), "msgpack"), *KIND))


@query(STORED)
def load_csv(spark, sf_dir):
    return _with_media(Corpus.of_documents(_stored(spark, A.intervals(spark, sf_dir).documents(), "csv"), *KIND))


@query(STORED)
def load_parquet(spark, sf_dir):
    path = fresh(spark, "corpus")
    save_corpus(A.intervals(spark, sf_dir), path)
    return _with_media(load_corpus(spark, path, *KIND))


@query(STORED)
def table_round_trip(spark, sf_dir):
    """The table form and back."""
    corpus = A.intervals(spark, sf_dir)
    return _with_media(from_table(corpus.table(), corpus.headers))


@query(f"""with {POINTS}, p as (select user_id as annotation, row_number() over (partition by user_id order by ts, event_id) - 1 as obs_index, cast(json_extract(props, '$.k') as bigint) as k from events)
  select 'user:' || annotation as media_id, obs_index, k from p""")
def csv_objects(spark, sf_dir):
    """Free-form objects as cells of CSV."""
    events = A.read(spark, sf_dir, "events")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    rows = A.with_index(events, "user_id", "ts", "event_id").select(F.col("user_id").alias("annotation"), "obs_index", (micros / F.lit(1e6)).alias("extent_time"), F.col("props").alias("payload_value"))
    back = Corpus.of_documents(_stored(spark, Corpus.build(rows, "object", "time", media="user:").documents(), "csv"), "object", "time")
    return _with_media(back).select("media_id", "obs_index", F.get_json_object("payload_value", "$.k").cast("bigint").alias("k"))


@query("""select 'brand:' || p_brand as media_id, row_number() over (partition by p_brand order by p_partkey) - 1 as obs_index,
  p_partkey as num, cast(4 as bigint) as den, cast(p_size as bigint) as long_num, cast(3 as bigint) as long_den from part""")
def csv_fractions(spark, sf_dir):
    """Fractions as cells of CSV."""
    back = Corpus.of_documents(_stored(spark, A.quarters(spark, sf_dir).documents(), "csv"), "lyrics", "score_interval")
    q, d = "extent_quarter", "extent_duration"
    return _with_media(back).select("media_id", "obs_index", F.col(f"{q}.num").alias("num"), F.col(f"{q}.den").alias("den"), F.col(f"{d}.num").alias("long_num"), F.col(f"{d}.den").alias("long_den"))


@query("select case c_custkey % 3 when 1 then '1.7' else '1.0' end as version, 'v1' as registry, count(*) as n from customer group by all")
def version_sniff(spark, sf_dir):
    """Lines with a version of the series, the present one, and none."""
    version = F.expr(f"""case c_custkey % 3 when 1 then '"{catalog.VERSION_FIELD}":"1.7",' when 2 then '"{catalog.VERSION_FIELD}":"1.0",' else '' end""")
    line = F.concat(F.lit("{"), version, F.expr("""'"media_id":"customer:' || c_custkey || '","payload":{"payload_type":"tag_open","value":["' || c_mktsegment || '"]}}'"""))
    path = fresh(spark, "versions")
    A.read(spark, sf_dir, "customer").select(line).write.text(path)
    return read_lines(spark, path).groupBy("version", scalar.registry_key(F.col("version")).alias("registry")).agg(F.count("*").alias("n"))


@query("""select 'tag_open' as payload_type, null as extent_type, null as confidence_type, count(*) as n from customer
  union all select 'lyrics', 'score_interval', null, count(distinct p_brand) from part
  union all select 'segment_open', 'time_interval', 'likelihood', count(distinct l_orderkey) from lineitem""")
def tags_count(spark, sf_dir):
    """Documents of several kinds side by side, by their tags."""
    parts = [c.documents(ids=False) for c in (A.segment_labels(spark, sf_dir), A.quarters(spark, sf_dir), A.intervals(spark, sf_dir))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("payload_type", "extent_type", "confidence_type").agg(F.count("*").alias("n"))


@query("""select 'customer:' || c_custkey as media_id, '1.0' as version, 'nation/' || c_nationkey as payload_ext_schema, c_nationkey as value from customer""")
def ext_headers(spark, sf_dir):
    """An extension payload through MessagePack: its schema stands in the header, its values are free."""
    customer = A.read(spark, sf_dir, "customer")
    rows = customer.select(F.col("c_custkey").alias("annotation"), F.lit(0).cast("long").alias("obs_index"), F.to_json(F.struct(F.col("c_nationkey").alias("n"))).alias("payload_value"))
    corpus = Corpus.build(rows, "ext", media="customer:")
    schema = F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string"))
    corpus = corpus.with_(headers=corpus.headers.join(customer.select(F.col("c_custkey").alias("annotation"), schema.alias("payload_ext_schema")), "annotation"))
    back = Corpus.of_documents(_stored(spark, corpus.documents(), "msgpack"), "ext")
    rows = back.headers.join(back.observations, "annotation")
    return rows.select("media_id", "version", "payload_ext_schema", F.get_json_object("payload_value", "$.n").cast("int").alias("value"))


def _sql_uuid(text: str) -> str:
    h = f"sha1(from_hex('{NAMESPACE}') || encode({text}))"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', cast('0x' || substr({h}, 17, 1) as int) % 4 + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


OTHER = "'00000000-0000-5000-8000-000000000000'"


@query(f"""with c as (select c_custkey, {_sql_uuid(ID_JSON)} as own from customer)
  select 'check or set' as policy, c_custkey, own as id from c where c_custkey % 3 <> 2
  union all select 'check', c_custkey, case when c_custkey % 3 = 0 then own end from c where c_custkey % 3 <> 2
  union all select 'overwrite', c_custkey, own from c
  union all select 'leave', c_custkey, case c_custkey % 3 when 0 then own when 2 then {OTHER} end from c""")
def id_policies(spark, sf_dir):
    """What saving makes of right (0), missing (1) and wrong (2) ids under the four policies."""
    docs = A.segment_labels(spark, sf_dir).documents()
    n = F.col("annotation").cast("bigint") % 3
    docs = docs.withColumn("id", F.when(n == 0, F.col("id")).when(n == 2, F.lit(OTHER.strip("'"))))
    out = None
    for policy, validate, generate in (("check or set", True, True), ("check", True, False), ("overwrite", False, True), ("leave", False, False)):
        path = fresh(spark, "policy")
        write_documents(docs.where(n != 2) if validate else docs, path, validate_id=validate, generate_id=generate)
        got = read_lines(spark, path).select(F.lit(policy).alias("policy"), F.substring_index("media_id", ":", -1).cast("bigint").alias("c_custkey"), "id")
        out = got if out is None else out.unionByName(got)
    return out


@query("select c_custkey, case c_custkey % 3 when 0 then 'right' when 1 then 'missing' else 'wrong' end as state from customer")
def id_states(spark, sf_dir):
    customer = A.read(spark, sf_dir, "customer").withColumn("text", F.expr(ID_JSON))
    n = F.col("c_custkey") % 3
    given = F.when(n == 0, identity.uuid5(F.col("text"))).when(n == 2, F.lit(OTHER.strip("'")))
    return customer.select("c_custkey", identity.id_state(F.col("text"), given).alias("state"))


@query(f"select 'customer:' || c_custkey as media_id, {_sql_uuid(ID_JSON)} as id, c_mktsegment as value from customer")
def create_documents(spark, sf_dir):
    """Documents made from arguments, one by one."""

    def make(batches):
        for pdf in batches:
            docs = [create(media_id=f"customer:{k}", payload_kind="tag_open", value=[v]) for k, v in zip(pdf["c_custkey"], pdf["c_mktsegment"])]
            yield pd.DataFrame({"media_id": [d["media_id"] for d in docs], "id": [d["id"] for d in docs], "value": [d["payload"]["value"][0] for d in docs]})

    return A.read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").mapInPandas(make, "media_id string, id string, value string")


def _json_trimmed(start: str, parents: str) -> str:
    """Canonical JSON of a customer's tag after a trim, as SQL text."""
    metadata = '{"metadata_type":"derived","parameters":{"end":null,"reset":false,"start":START,"strict":false,"target_field":null},"transform":"trim"}'.replace("START", start)
    head = """'{"VERSION":"1.0","media_id":"customer:' || c_custkey || '","metadata":METADATA,"parents":[' || PARENTS || '],"payload":{"payload_type":"tag_open","value":["' || c_mktsegment || '"]}}'"""
    return head.replace("VERSION", catalog.VERSION_FIELD).replace("METADATA", metadata).replace("PARENTS", parents)


@query(f"""with a as (select *, {_sql_uuid(ID_JSON)} as id0 from customer),
  b as (select *, {_sql_uuid(_json_trimmed("1.5", "'\"' || id0 || '\"'"))} as id1 from a)
  select c_custkey as annotation, id0 as parent, id1 as last_parent, 2 as n_parents, {_sql_uuid(_json_trimmed("2.5", "'\"' || id0 || '\",\"' || id1 || '\"'"))} as id from b""")
def lineage_chain(spark, sf_dir):
    """Two transforms: the second's result names the first's by an id that is computed on the way."""
    corpus = trim(trim(A.segment_labels(spark, sf_dir).identified(), start=1.5), start=2.5).identified()
    parents = F.col("parents")
    return corpus.headers.select("annotation", parents[0].alias("parent"), parents[1].alias("last_parent"), F.size(parents).alias("n_parents"), "id")


@query("""with p as (select p_brand as annotation, row_number() over (partition by p_brand order by p_partkey) - 1 as obs_index, p_partkey, p_size from part)
  select annotation, obs_index, 'extent_quarter' as field from p where p_partkey % 5 = 0
  union all select annotation, obs_index, 'extent_duration' from p where p_size - 10 < 0""")
def validate_fractions(spark, sf_dir):
    """Fractions with denominator zero, and negative ones where the format wants none."""
    corpus = A.quarters(spark, sf_dir)
    rows = A.with_index(A.read(spark, sf_dir, "part"), "p_brand", "p_partkey")
    pair = lambda n, d: F.struct(n.cast("long").alias("num"), d.cast("long").alias("den"))
    rows = rows.select(F.col("p_brand").alias("annotation"), "obs_index", pair(F.col("p_partkey"), F.col("p_partkey") % 5).alias("extent_quarter"), pair(F.col("p_size") - 10, F.lit(3)).alias("extent_duration"), F.col("p_type").alias("payload_value"))
    return violations(corpus.with_(observations=rows))


@query("""select c_custkey as annotation, field from customer, (values ('media_id'), ('version'), ('id')) f(field)
  where case field when 'media_id' then c_custkey % 4 = 0 when 'version' then c_custkey % 5 = 0 else c_custkey % 6 = 0 end""")
def validate_headers(spark, sf_dir):
    """Media ids without a colon, versions out of the series, ids that are no such identifiers."""
    corpus, k = A.segment_labels(spark, sf_dir), F.col("annotation")
    headers = corpus.headers.withColumns({"media_id": F.when(k % 4 == 0, F.lit("no colon")).otherwise(F.col("media_id")), "version": F.when(k % 5 == 0, F.lit("2.0")).otherwise(F.col("version")), "id": F.when(k % 6 == 0, F.lit("x-1")).otherwise(F.lit(OTHER.strip("'")))})
    return violations(corpus.with_(headers=headers)).select("annotation", "field")


@query("select l_orderkey as annotation, count(*) as n from lineitem where l_orderkey % 7 = 0 group by 1")
def lengths_unequal(spark, sf_dir):
    """Annotations of which one list lost its last value."""
    nested = A.intervals(spark, sf_dir).nested()
    shorter = F.when(F.col("annotation") % 7 == 0, F.slice("extent_duration", 1, F.size("extent_duration") - 1)).otherwise(F.col("extent_duration"))
    bad = unequal_lengths(nested.withColumn("extent_duration", shorter), ["payload_value", "extent_time", "extent_duration"])
    return bad.select("annotation", F.size("payload_value").cast("bigint").alias("n"))


@query("select p_partkey, case when p_size % 3 > 0 then 'v1' end as registry from part")
def versions_map(spark, sf_dir):
    """1, 1.x and 2.x."""
    version = F.expr("case p_size % 3 when 0 then '2.' || p_size when 1 then '1' else '1.' || p_size end")
    return A.read(spark, sf_dir, "part").select("p_partkey", scalar.registry_key(version).alias("registry"))


@query("""select * from (values ('extent', 'score_interval', 'quarter,duration'), ('extent', 'score_quarter', 'quarter'), ('payload', 'ext', 'value'), ('payload', 'object', 'value'),
  ('payload', 'onset', 'value'), ('payload', 'pitch_contour', 'value')) t(facet, tag, fields)""")
def registry_complex(spark, sf_dir):
    """The fields that hold structured values, from the registry."""
    rows = [(facet, tag, ",".join(names)) for (facet, tag), names in catalog.registry("1.0")["complex"].items() if names]
    return spark.createDataFrame(rows, "facet string, tag string, fields string")


@query("""select * from (values ('payload:beat:value extent:time:time', 'payload=beat extent=time'), ('payload:beat', 'InvalidAnnotation'), ('payload:none:value', 'InvalidAnnotation'),
  ('payload:beat:size', 'InvalidAnnotation'), ('payload:beat:value payload:chord:value', 'InvalidAnnotation'), ('extent:time:time', 'InvalidAnnotation')) t(names, result)""")
def columns_check(spark, sf_dir):
    """Names of tables' columns and what the check says."""

    def result(names: str) -> str:
        try:
            return " ".join(f"{k}={v}" for k, v in check_columns(names.split()).items())
        except errors.InvalidAnnotation as e:
            return type(e).__name__

    cases = ["payload:beat:value extent:time:time", "payload:beat", "payload:none:value", "payload:beat:size", "payload:beat:value payload:chord:value", "extent:time:time"]
    return spark.createDataFrame([(c, result(c)) for c in cases], "names string, result string")


@query("""select * from (values ('trim: no bound', 'BadArgument'), ('trim: turned bounds', 'BadArgument'), ('trim: reset without start', 'BadArgument'), ('trim: no such axis', 'BadArgument'),
  ('trim: no default axis', 'BadArgument'), ('filter_by: no such facet', 'BadArgument'), ('filter_by: no such field', 'BadArgument'), ('to_times: no grid', 'BadArgument'), ('to_times: two grids', 'BadArgument'),
  ('to_times: rate 0', 'BadArgument'), ('to_times: method', 'BadArgument'), ('to_times: overlap', 'BadArgument'), ('to_times: extent', 'BadArgument'), ('to_times: fields without fill', 'BadArgument'),
  ('evaluate: no task', 'BadArgument'), ('evaluate: extent', 'BadArgument'), ('create: left over', 'BadArgument'), ('create: type', 'UnknownType'), ('create: lengths', 'UnequalLengths'), ('version', 'UnknownType')) t(call, error)""")
def argument_errors(spark, sf_dir):
    """Calls that must fail, and the error of each."""
    points, pixels, ticks, texts = A.points(spark, sf_dir), A.pixels(spark, sf_dir), A.ticks(spark, sf_dir), A.texts(spark, sf_dir)
    moods = Corpus.build(points.observations.select("annotation", "obs_index", "extent_time", F.lit(0.5).alias("payload_valence"), F.lit(0.5).alias("payload_arousal")), "mood_thayer", "time")
    calls = {
        "trim: no bound": lambda: trim(points),
        "trim: turned bounds": lambda: trim(points, start=2, end=1),
        "trim: reset without start": lambda: trim(points, end=1, reset=True),
        "trim: no such axis": lambda: trim(points, start=1, target_field="frequency"),
        "trim: no default axis": lambda: trim(pixels, start=1),
        "filter_by: no such facet": lambda: filter_by(points, lambda v: v == "", facet="colour"),
        "filter_by: no such field": lambda: filter_by(points, lambda v: v == "", target="colour"),
        "to_times: no grid": lambda: to_times(points),
        "to_times: two grids": lambda: to_times(points, times=[1.0], sample_rate=1.0),
        "to_times: rate 0": lambda: to_times(points, sample_rate=0),
        "to_times: method": lambda: to_times(points, times=[1.0], method="linear"),
        "to_times: overlap": lambda: to_times(points, times=[1.0], overlap="all"),
        "to_times: extent": lambda: to_times(ticks, times=[1.0]),
        "to_times: fields without fill": lambda: to_times(moods, times=[1.0], fill_value={"valence": 0.0}),
        "evaluate: no task": lambda: evaluate(texts, texts),
        "evaluate: extent": lambda: evaluate(pixels, pixels, task="onset"),
        "create: left over": lambda: create(media_id="a:b", payload_kind="beat", value=[1], colour=1),
        "create: type": lambda: create(media_id="a:b", payload_kind="colour", value=[1]),
        "create: lengths": lambda: create(media_id="a:b", payload_kind="beat", extent_kind="time", value=[1], time=[1.0, 2.0]),
        "version": lambda: catalog.registry_version("2.0"),
    }
    rows = []
    for name, call in calls.items():
        try:
            call()
            rows.append((name, None))
        except errors.AnnotationError as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "call string, error string")


@query("""select * from (values ('beat', 'value'), ('chord', 'value'), ('ext', 'ext_schema,value'), ('key_mode', 'value'), ('lyrics', 'value'), ('mood_thayer', 'arousal,valence'), ('multi_segment', 'label,level'),
  ('note_hz', 'value'), ('note_midi', 'value'), ('object', 'value'), ('onset', 'value'), ('pitch_contour', 'value'), ('relation', 'performance_id,relation,value'), ('segment_open', 'value'), ('tag_open', 'value'),
  ('tempo', 'value')) t(tag, fields)""")
def schema_round_trip(spark, sf_dir):
    """Payloads whose fields are read back whole from their JSON schema."""
    rows = []
    for tag, own in catalog.CATALOG["payload"].items():
        got, fields = namespaces.from_schema(namespaces.schema_of(tag))
        if got == tag and fields == own:
            rows.append((tag, ",".join(sorted(fields))))
    return spark.createDataFrame(rows, "tag string, fields string")


def _streamed(spark: SparkSession, corpus: Corpus, make) -> DataFrame:
    """A corpus's observations as a stream of files, through an operator, into a table."""
    source, out, state = fresh(spark, "stream-in"), fresh(spark, "stream-out"), fresh(spark, "stream-state")
    corpus.observations.write.parquet(source)
    stream = spark.readStream.schema(corpus.observations.schema).option("maxFilesPerTrigger", 2).parquet(source)
    made = make(corpus, stream)
    run = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


@query(f"with {POINTS} select * replace (extent_time - {LO} as extent_time) from points where extent_time >= {LO} and extent_time <= {HI}")
def stream_trim(spark, sf_dir):
    return _streamed(spark, A.points(spark, sf_dir), lambda c, s: trim_stream(c, s, start=LO, end=HI, reset=True))


@query(f"with {POINTS} select * from points where payload_value = 'purchase'")
def stream_filter(spark, sf_dir):
    return _streamed(spark, A.points(spark, sf_dir), lambda c, s: filter_stream(c, s, lambda v: v == "purchase"))
