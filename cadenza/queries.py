"""The registered queries of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza import catalog
from cadenza.functions import identity, scalar
from cadenza.operators import filter_by, to_times, trim, violations
from cadenza.plans import adapters as A
from cadenza.registry import QUERIES, SQL, query

DAY = 86400.0
SINCE = 1704067200.0  # 2024-01-01
GRID = [SINCE + DAY * x for x in (0.5, 3.0, 7.25, 7.25, 20.0, 40.0)]  # in the caller's order, one repeated
DAYS = [9200.0, 9400.5, 10000.0, 10950.0, 11500.0]

POINTS = """points as (select user_id as annotation, row_number() over (partition by user_id order by ts, event_id) - 1 as obs_index,
  epoch_us(ts) / 1e6 as extent_time, event_type as payload_value, value / 500 as confidence_confidence from events)"""
SPANS = """spans as (select l_orderkey as annotation,
  row_number() over (partition by l_orderkey order by l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice) - 1 as obs_index,
  cast(date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as double) as extent_time, l_quantity as extent_duration,
  l_returnflag as payload_value, l_discount as confidence_confidence from lineitem)"""
BOXES = """boxes as (select p_brand as annotation, row_number() over (partition by p_brand order by p_partkey) - 1 as obs_index,
  cast(p_partkey as double) as extent_time, cast(p_size as double) as extent_duration, p_retailprice as extent_freq_min,
  p_retailprice + cast(p_size as double) as extent_freq_max, p_type as payload_value from part)"""
PIXELS = """pixels as (select p_brand as annotation, row_number() over (partition by p_brand order by p_partkey) - 1 as obs_index,
  cast(p_partkey as double) as extent_x, p_retailprice as extent_y, cast(p_size as double) as extent_width,
  cast(p_size as double) as extent_height, p_type as payload_value from part)"""
NAMESPACE = catalog.NAMESPACE.replace("-", "")
LO, HI = SINCE + 2 * DAY, SINCE + 9 * DAY


@query(f"with {POINTS} select * from points where extent_time >= {LO} and extent_time <= {HI}")
def trim_point(spark, sf_dir):
    return trim(A.points(spark, sf_dir), start=LO, end=HI).observations


@query(f"with {POINTS} select * replace (extent_time - {LO} as extent_time) from points where extent_time >= {LO} and extent_time <= {HI}")
def trim_point_reset(spark, sf_dir):
    return trim(A.points(spark, sf_dir), start=LO, end=HI, reset=True).observations


@query(f"with {POINTS} select * from points where extent_time <= {HI}")
def trim_point_open_start(spark, sf_dir):
    return trim(A.points(spark, sf_dir), end=HI).observations


@query(f"with {POINTS} select * from points where extent_time >= {LO}")
def trim_point_open_end(spark, sf_dir):
    return trim(A.points(spark, sf_dir), start=LO).observations


@query(f"""with {POINTS} select payload_value, count(*) as n from points where extent_time >= {LO} and extent_time <= {HI} group by payload_value""")
def trim_counts(spark, sf_dir):
    return trim(A.points(spark, sf_dir), start=LO, end=HI, reset=True).observations.groupBy("payload_value").agg(F.count("*").alias("n"))


CLIPPED = """select * replace ({start}{shift} as extent_time, {end} - {start} as extent_duration) from spans
  where extent_time + extent_duration > 9400.5 and extent_time < 10000.25""".replace("{start}", "greatest(extent_time, 9400.5)").replace("{end}", "least(extent_time + extent_duration, 10000.25)")


@query(f"with {SPANS} " + CLIPPED.replace("{shift}", ""))
def trim_span(spark, sf_dir):
    return trim(A.intervals(spark, sf_dir), start=9400.5, end=10000.25).observations


@query(f"with {SPANS} " + CLIPPED.replace("{shift}", " - 9400.5"))
def trim_span_reset(spark, sf_dir):
    return trim(A.intervals(spark, sf_dir), start=9400.5, end=10000.25, reset=True).observations


@query(f"with {SPANS} select * replace ((extent_time + extent_duration) - extent_time as extent_duration) from spans where extent_time >= 9400.5 and extent_time + extent_duration <= 10000.25")
def trim_span_strict(spark, sf_dir):
    return trim(A.intervals(spark, sf_dir), start=9400.5, end=10000.25, strict=True).observations


@query(f"""with {BOXES} select * replace (greatest(extent_freq_min, 920.0) as extent_freq_min, least(extent_freq_max, 990.0) as extent_freq_max) from boxes
  where extent_freq_max > 920.0 and extent_freq_min < 990.0""")
def trim_freq(spark, sf_dir):
    return trim(A.boxes(spark, sf_dir), start=920.0, end=990.0, target_field="frequency").observations


@query(f"with {BOXES} select * from boxes where extent_freq_min >= 920.0 and extent_freq_max <= 990.0")
def trim_freq_strict(spark, sf_dir):
    return trim(A.boxes(spark, sf_dir), start=920.0, end=990.0, target_field="frequency", strict=True).observations


@query(f"""with {PIXELS} select * replace (greatest(extent_x, 20.0) - 20.0 as extent_x, least(extent_x + extent_width, 70.0) - greatest(extent_x, 20.0) as extent_width)
  from pixels where extent_x + extent_width > 20.0 and extent_x < 70.0""")
def trim_pixel_x(spark, sf_dir):
    return trim(A.pixels(spark, sf_dir), start=20.0, end=70.0, target_field="x", reset=True).observations


@query(f"""with {PIXELS} select * replace (greatest(extent_y, 950.0) as extent_y, (extent_y + extent_height) - greatest(extent_y, 950.0) as extent_height)
  from pixels where extent_y + extent_height > 950.0""")
def trim_pixel_y(spark, sf_dir):
    return trim(A.pixels(spark, sf_dir), start=950.0, target_field="y").observations


@query(f"""with {BOXES} select * replace (greatest(extent_time, 90.5) - 90.5 as extent_time, least(extent_time + extent_duration, 1500.0) - greatest(extent_time, 90.5) as extent_duration)
  from boxes where extent_time + extent_duration > 90.5 and extent_time < 1500.0""")
def trim_box_time(spark, sf_dir):
    return trim(A.boxes(spark, sf_dir), start=90.5, end=1500.0, reset=True).observations


TICKS = """ticks as (select p_brand as annotation, row_number() over (partition by p_brand order by p_partkey) - 1 as obs_index,
  cast(p_partkey as double) as extent_tick, cast(p_size as double) as extent_duration, p_type as payload_value from part)"""
QUARTERS = """quarters as (select p_brand as annotation, row_number() over (partition by p_brand order by p_partkey) - 1 as obs_index,
  p_partkey / 4.0 as q, p_size / 3.0 as d, p_type as payload_value from part)"""


@query(f"with {TICKS} select annotation, obs_index, extent_tick - 120.0 as extent_tick, payload_value from ticks where extent_tick >= 120.0 and extent_tick <= 960.0")
def trim_tick(spark, sf_dir):
    ticks = A.ticks(spark, sf_dir)
    return trim(A.Corpus.build(ticks.observations, "lyrics", "midi_tick"), start=120.0, end=960.0, reset=True).observations


@query(f"""with {TICKS} select * replace (greatest(extent_tick, 120.0) as extent_tick, least(extent_tick + extent_duration, 960.0) - greatest(extent_tick, 120.0) as extent_duration)
  from ticks where extent_tick + extent_duration > 120.0 and extent_tick < 960.0""")
def trim_tick_interval(spark, sf_dir):
    return trim(A.ticks(spark, sf_dir), start=120.0, end=960.0).observations


def _value(name: str):
    return F.round(F.col(f"{name}.num") / F.col(f"{name}.den"), 6).alias(name)


@query(f"with {QUARTERS} select annotation, obs_index, round(q - 7.25, 6) as extent_quarter, payload_value from quarters where q >= 7.25 and q <= 300.5")
def trim_quarter(spark, sf_dir):
    rows = trim(A.Corpus.build(A.quarters(spark, sf_dir).observations, "lyrics", "score_quarter"), start=7.25, end=300.5, reset=True).observations
    return rows.select("annotation", "obs_index", _value("extent_quarter"), "payload_value")


@query(f"""with {QUARTERS} select annotation, obs_index, round(greatest(q, 7.25), 6) as extent_quarter, round(least(q + d, 300.5) - greatest(q, 7.25), 6) as extent_duration, payload_value
  from quarters where round(q + d, 9) > 7.25 and q < 300.5""")
def trim_quarter_interval(spark, sf_dir):
    rows = trim(A.quarters(spark, sf_dir), start=7.25, end=300.5).observations
    return rows.select("annotation", "obs_index", _value("extent_quarter"), _value("extent_duration"), "payload_value")


@query("select cast(doc_id as bigint) as annotation, cast(0 as bigint) as obs_index, text as payload_value from documents")
def trim_no_extent(spark, sf_dir):
    return trim(A.texts(spark, sf_dir), start=1.0).observations


@query(f"with {POINTS} select * from points where payload_value = 'purchase'")
def filter_payload(spark, sf_dir):
    return filter_by(A.points(spark, sf_dir), lambda v: v == "purchase").observations


@query(f"with {SPANS} select * from spans where extent_duration > 25")
def filter_extent(spark, sf_dir):
    return filter_by(A.intervals(spark, sf_dir), lambda d: d > 25, target="duration", facet="extent").observations


@query(f"with {SPANS} select * from spans where extent_time + extent_duration > 11000")
def filter_extent_record(spark, sf_dir):
    return filter_by(A.intervals(spark, sf_dir), lambda r: r.time + r.duration > 11000, facet="extent").observations


@query(f"with {POINTS} select * from points where confidence_confidence >= 0.5")
def filter_confidence(spark, sf_dir):
    return filter_by(A.points(spark, sf_dir), lambda c: c >= 0.5, facet="confidence").observations


@query(f"with {POINTS} select * from points where confidence_confidence >= 0.25 and starts_with(payload_value, 'p')")
def filter_record_all(spark, sf_dir):
    return filter_by(A.points(spark, sf_dir), lambda r: (r.confidence >= 0.25) & r.value.startswith("p"), facet="all").observations


@query(f"with {POINTS} select * from points where confidence_confidence < 0.1")
def filter_target_all(spark, sf_dir):
    return filter_by(A.points(spark, sf_dir), lambda c: c < 0.1, target="confidence", facet="all").observations


@query(f"with {POINTS} select * from points where length(payload_value) = 6")
def filter_python(spark, sf_dir):
    return filter_by(A.points(spark, sf_dir), lambda v: len(v) == 6, python=True).observations


@query(f"with {POINTS} select * from points where confidence_confidence >= 0.5 and payload_value <> 'view' and extent_time < {HI}")
def filter_record_python(spark, sf_dir):
    """A record's fields by item and by attribute, in plain Python."""
    return filter_by(A.points(spark, sf_dir), lambda r: r["confidence"] >= 0.5 and r.value != "view" and r.time < HI, facet="all", python=True).observations


GRID_SQL = "grid as (select * from (values " + ", ".join(f"(cast({i} as bigint), cast({t} as double))" for i, t in enumerate(GRID)) + ") g(obs_index, extent_time)), users as (select distinct user_id as annotation from events)"
PREVIOUS = f"""with {POINTS}, {GRID_SQL}
  select u.annotation, g.obs_index, g.extent_time, {{value}} as payload_value, {{confidence}} as confidence_confidence
  from users u cross join grid g left join (
    select g2.obs_index as k, p.annotation, max(p.obs_index) as i from grid g2 join points p on p.extent_time <= g2.extent_time group by 1, 2) m
    on m.k = g.obs_index and m.annotation = u.annotation
  left join points p on p.annotation = u.annotation and p.obs_index = m.i"""


@query(PREVIOUS.format(value="coalesce(p.payload_value, 'none')", confidence="coalesce(p.confidence_confidence, 0.0)"))
def times_previous(spark, sf_dir):
    return to_times(A.points(spark, sf_dir), times=GRID, fill_value="none").observations


@query(PREVIOUS.format(value="coalesce(p.payload_value, 'none')", confidence="coalesce(p.confidence_confidence, 0.05)"))
def times_previous_fill(spark, sf_dir):
    return to_times(A.points(spark, sf_dir), times=GRID, fill_value={"value": "none", "confidence": 0.05}).observations


@query(f"""with {POINTS}, {GRID_SQL}, near as (
    select p.annotation, g.obs_index, g.extent_time, p.payload_value, p.confidence_confidence,
      row_number() over (partition by p.annotation, g.obs_index order by abs(p.extent_time - g.extent_time), p.obs_index) as k
    from points p cross join grid g)
  select annotation, obs_index, extent_time, payload_value, confidence_confidence from near where k = 1""")
def times_nearest(spark, sf_dir):
    return to_times(A.points(spark, sf_dir), times=GRID, method="nearest").observations


DAYS_SQL = "grid as (select * from (values " + ", ".join(f"(cast({i} as bigint), cast({t} as double))" for i, t in enumerate(DAYS)) + ") g(obs_index, extent_time)), orders_ as (select distinct l_orderkey as annotation from lineitem)"
COVER = f"""with {SPANS}, {DAYS_SQL}, cover as (
    select s.annotation, g.obs_index as k, s.obs_index as i, s.payload_value, s.confidence_confidence
    from spans s join grid g on s.extent_time <= g.extent_time and g.extent_time <= s.extent_time + s.extent_duration),
  picked as (select *, row_number() over (partition by annotation, k order by i {{order}}) as pick from cover)
  select o.annotation, g.obs_index, g.extent_time, case when p.annotation is null then 'gap' else p.payload_value end as payload_value,
    case when p.annotation is null then 0.0 else p.confidence_confidence end as confidence_confidence
  from orders_ o cross join grid g left join picked p on p.annotation = o.annotation and p.k = g.obs_index and p.pick = 1"""


@query(COVER.format(order="desc"))
def times_latest(spark, sf_dir):
    return to_times(A.intervals(spark, sf_dir), times=DAYS, fill_value="gap").observations


@query(COVER.format(order="asc"))
def times_first(spark, sf_dir):
    return to_times(A.intervals(spark, sf_dir), times=DAYS, overlap="first", fill_value="gap").observations


@query(f"""with {SPANS}, {DAYS_SQL}, rows_ as (
    select o.annotation, g.obs_index as k, s.obs_index as i, g.extent_time, coalesce(s.payload_value, 'gap') as payload_value, coalesce(s.confidence_confidence, 0.0) as confidence_confidence
    from orders_ o cross join grid g left join spans s on s.annotation = o.annotation and s.extent_time <= g.extent_time and g.extent_time <= s.extent_time + s.extent_duration)
  select annotation, row_number() over (partition by annotation order by k, i) - 1 as obs_index, extent_time, payload_value, confidence_confidence from rows_""")
def times_multiple(spark, sf_dir):
    return to_times(A.intervals(spark, sf_dir), times=DAYS, overlap="multiple", fill_value="gap").observations


@query(f"""with {SPANS}, bounds as (
    select annotation, min(extent_time) as t0, cast(floor((max(extent_time + extent_duration) - min(extent_time)) / 32.0 + 1e-9) as bigint) as last from spans group by annotation),
  grid as (select annotation, g as obs_index, t0 + g * 32.0 as extent_time from (select *, unnest(range(last + 1)) as g from bounds)),
  cover as (select g.annotation, g.obs_index, max(s.obs_index) as i from grid g join spans s on s.annotation = g.annotation
    and s.extent_time <= g.extent_time and g.extent_time <= s.extent_time + s.extent_duration group by 1, 2)
  select g.annotation, g.obs_index, g.extent_time, coalesce(s.payload_value, 'gap') as payload_value, coalesce(s.confidence_confidence, 0.0) as confidence_confidence
  from grid g left join cover c on c.annotation = g.annotation and c.obs_index = g.obs_index
  left join spans s on s.annotation = c.annotation and s.obs_index = c.i""")
def times_sample_rate(spark, sf_dir):
    return to_times(A.intervals(spark, sf_dir), sample_rate=1 / 32, fill_value="gap").observations


@query("""select doc_id as annotation, g.obs_index, g.extent_time, text as payload_value from documents
  cross join (values (cast(0 as bigint), cast(0.0 as double)), (1, 1.5), (2, 3.0)) g(obs_index, extent_time)""")
def times_global(spark, sf_dir):
    return to_times(A.texts(spark, sf_dir), times=[0.0, 1.5, 3.0]).observations


@query("select distinct user_id as annotation, 0 as n, 'time' as extent_type from events")
def times_empty_grid(spark, sf_dir):
    """No times: all annotations stay, without observations."""
    out = to_times(A.points(spark, sf_dir), times=[])
    counts = out.observations.groupBy("annotation").agg(F.count("*").alias("n"))
    return out.headers.join(counts, "annotation", "left").select("annotation", F.coalesce("n", F.lit(0)).alias("n"), F.lit(out.extent_type).alias("extent_type"))


@query("""with o as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as k from orders),
  first as (select o_custkey, o_orderpriority from orders join (select o_custkey as c, o_orderkey as key from o where k = 1) on o_custkey = c and o_orderkey = key)
  select c_custkey as annotation, g.obs_index, g.extent_time, coalesce(o_orderpriority, 'none') as payload_value from customer
  cross join (values (cast(0 as bigint), cast(2.0 as double)), (1, 1.0)) g(obs_index, extent_time) left join first on o_custkey = c_custkey""")
def times_empty_source(spark, sf_dir):
    """Customers with and without orders: the first order's priority holds from 0 on, customers without any get the fill."""
    orders = A.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("payload_value"))
    rows = orders.select(F.col("o_custkey").alias("annotation"), F.lit(0).cast("long").alias("obs_index"), F.lit(0.0).alias("extent_time"), "payload_value")
    customers = A.segment_labels(spark, sf_dir).headers
    return to_times(A.Corpus.build(rows, "lyrics", "time", headers=customers), times=[2.0, 1.0], fill_value="none").observations


@query(f"""with {SPANS}, {DAYS_SQL}, cover as (
    select s.annotation, g.obs_index as k, max(s.obs_index) as i from spans s join grid g on s.extent_time <= g.extent_time and g.extent_time <= s.extent_time + s.extent_duration group by 1, 2)
  select o.annotation, g.obs_index, g.extent_time, case s.payload_value when 'A' then 'A:min' when 'N' then 'G:maj/5' when 'R' then 'D:sus4(b7)' else 'N' end as payload_value
  from orders_ o cross join grid g left join cover c on c.annotation = o.annotation and c.k = g.obs_index left join spans s on s.annotation = c.annotation and s.obs_index = c.i""")
def times_fill_chord(spark, sf_dir):
    """Gaps in chords, with a fill that the chord grammar allows."""
    spans = A.intervals(spark, sf_dir).observations
    chord = F.element_at(F.create_map(*[F.lit(x) for x in ("A", "A:min", "N", "G:maj/5", "R", "D:sus4(b7)")]), F.col("payload_value"))
    rows = spans.select("annotation", "obs_index", "extent_time", "extent_duration", chord.alias("payload_value"))
    return to_times(A.Corpus.build(rows, "chord", "time_interval"), times=DAYS, fill_value="N").observations


@query(f"with {SPANS} select annotation, obs_index, payload_value as \"payload:segment_open:value\", extent_time as \"extent:time_interval:time\", extent_duration as \"extent:time_interval:duration\", confidence_confidence as \"confidence:likelihood:confidence\" from spans")
def to_long(spark, sf_dir):
    return A.intervals(spark, sf_dir).table()


@query(f"""with {SPANS} select annotation, 'order:' || annotation as media_id, '1.0' as version, to_json(list(payload_value order by obs_index)) as payload_value,
  count(*) as n, sum(extent_duration) as total from spans group by annotation""")
def to_nested(spark, sf_dir):
    rows = A.intervals(spark, sf_dir).nested()
    total = F.aggregate("extent_duration", F.lit(0.0), lambda a, x: a + x)
    return rows.select("annotation", "media_id", "version", F.to_json("payload_value").alias("payload_value"), F.size("payload_value").cast("long").alias("n"), total.alias("total"))


@query(f"""with {POINTS}, {SPANS}
  select annotation, obs_index, 'confidence_confidence' as field from points where confidence_confidence * 5 > 1
  union all select annotation, obs_index, 'extent_duration' from spans where extent_duration - 25 < 0
  union all select annotation, obs_index, 'confidence_confidence' from spans where annotation % 7 = 0""")
def validate_ranges(spark, sf_dir):
    """Likelihoods over 1, negative durations, missing likelihoods."""
    points, spans = A.points(spark, sf_dir), A.intervals(spark, sf_dir)
    points = points.with_(observations=points.observations.withColumn("confidence_confidence", F.col("confidence_confidence") * 5))
    changed = spans.observations.withColumns({"extent_duration": F.col("extent_duration") - 25, "confidence_confidence": F.when(F.col("annotation") % 7 != 0, F.col("confidence_confidence"))})
    return violations(points).unionByName(violations(spans.with_(observations=changed)))


@query("""select p_partkey, p_brand, regexp_matches(p_brand, '^N|([A-G][b#]?)(:(major|minor|ionian|dorian|phrygian|lydian|mixolydian|aeolian|locrian))?$') as is_key,
  p_size % 12 = 0 as no_chord from part""")
def validate_grammar(spark, sf_dir):
    part = A.read(spark, sf_dir, "part")
    chord = F.when(F.col("p_size") % 12 == 0, "H:maj").otherwise(F.element_at(F.array(*[F.lit(x) for x in ("N", "C:maj", "A:min7", "G:maj/5", "Bb", "F#:(3,5)", "X", "D:sus4(b7)")]), (F.col("p_size") % 8 + 1).cast("int")))
    return part.select("p_partkey", "p_brand", scalar.is_key(F.col("p_brand")).alias("is_key"), (~scalar.is_chord(chord)).alias("no_chord"))


ID_JSON = """'{"VERSION":"1.0","media_id":"customer:' || c_custkey || '","payload":{"payload_type":"tag_open","value":["' || c_mktsegment || '"]}}'""".replace("VERSION", catalog.VERSION_FIELD)


@query(f"""with j as (select c_custkey, sha1(from_hex('{NAMESPACE}') || encode({ID_JSON})) as h from customer)
  select c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', cast('0x' || substr(h, 17, 1) as int) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as id from j""")
def id_hash(spark, sf_dir):
    """Identifiers by the canonical JSON, in the JVM."""
    customer = A.read(spark, sf_dir, "customer")
    return customer.select("c_custkey", identity.uuid5(F.expr(ID_JSON)).alias("id"))


@query(f"""with j as (select c_custkey, sha1(from_hex('{NAMESPACE}') || encode({ID_JSON})) as h from customer)
  select cast(c_custkey as varchar) as annotation, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', cast('0x' || substr(h, 17, 1) as int) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as id from j""")
def id_documents(spark, sf_dir):
    """The same identifiers from whole documents."""
    rows = A.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("annotation"), F.lit(0).cast("long").alias("obs_index"), F.col("c_mktsegment").alias("payload_value"))
    return A.Corpus.build(rows, "tag_open", media="customer:").documents().select("annotation", "id")


@query("select p_partkey, round(440.0 * pow(2.0, (p_size + 40 - 69.0) / 12.0), 6) as hz from part")
def midi_to_hz(spark, sf_dir):
    return A.read(spark, sf_dir, "part").select("p_partkey", F.round(scalar.midi_to_hz(F.col("p_size") + 40), 6).alias("hz"))


@query(f"with {POINTS}, n as (select *, lead(extent_time) over (partition by annotation order by obs_index) as until from points) select * from n where until is not null")
def intervals_from_points(spark, sf_dir):
    return scalar.intervals_from_points(A.points(spark, sf_dir).observations)


@query("""with t as (select *, row_number() over (partition by conv_id order by turn, role, text) as k from conversations)
  select conv_id as annotation, turn % 2 as level, to_json(list(role order by k)) as labels from t group by all""")
def level_groups(spark, sf_dir):
    return scalar.by_level(A.segments(spark, sf_dir).observations).withColumn("labels", F.to_json("labels"))


@query("select conv_id as annotation, to_json(list_sort(list_distinct(list(turn % 2)))) as levels from conversations group by conv_id")
def hierarchy_levels(spark, sf_dir):
    return scalar.levels(A.segments(spark, sf_dir).observations).withColumn("levels", F.to_json("levels"))


@query("select user_id as annotation, 'parent-' || user_id as parent, 1 as n_parents, 'trim' as transform from (select distinct user_id from events)")
def lineage_parents(spark, sf_dir):
    corpus = A.points(spark, sf_dir)
    corpus = corpus.with_(headers=corpus.headers.withColumn("id", F.concat(F.lit("parent-"), F.col("annotation").cast("string"))))
    headers = trim(corpus, start=LO).headers
    return headers.select("annotation", F.element_at("parents", -1).alias("parent"), F.size("parents").alias("n_parents"), F.get_json_object("metadata", "$.transform").alias("transform"))


@query("""select vec_id as annotation, i - 1 as obs_index, round(case when x >= 0 and 440.0 * (1.0 + x) > 0 then 440.0 * (1.0 + x) else -abs(440.0 * (1.0 + x)) end, 6) as hz
  from (select vec_id, unnest(range(1, len(embedding) + 1)) as i, cast(unnest(embedding) as double) as x from embeddings)""")
def melody_sign(spark, sf_dir):
    rows = A.contours(spark, sf_dir)
    return rows.select("annotation", "obs_index", F.round(scalar.signed_frequency(F.col("frequency"), F.col("voicing")), 6).alias("hz"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from cadenza import queries_eval, queries_io  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from cadenza import queries_eval, queries_io  # noqa: F401

    return dict(SQL)
