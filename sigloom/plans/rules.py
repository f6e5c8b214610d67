"""Queries of the rule engine, of scalar functions, and of sets of records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sigloom.functions import levels, strategy, text
from sigloom.operators import layout
from sigloom.plans import spans
from sigloom.plans import views as v
from sigloom.plans.signal_work import WELCH, mean_spectrum

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# profiles: what the detectors read from each track, in three passes: samples, mean spectrum, frame levels

PROFILE = f"""{WELCH}, near AS (SELECT *, coalesce(lag(x, 1) OVER w, 0) AS x1, coalesce(lag(x, 2) OVER w, 0) AS x2 FROM signal_long WINDOW w AS (PARTITION BY track ORDER BY ix)),
ps_samples AS (SELECT track, abs(avg(x)) > 0.02 AS dc, avg((abs(x) >= 0.98)::INTEGER) > 0.005 AS declip, avg((abs(x - 2 * x1 + x2) > 3.4)::INTEGER) > 0.001 AS declick,
  10 * log10((sum(x * x) FILTER (channel = 0) + 1e-12) / (sum(x * x) FILTER (channel = 1) + 1e-12)) AS balance_db,
  CASE WHEN greatest(sum(x * x1), sum(x * x2)) <= 0 THEN 0.0 WHEN sum(x * x1) >= sum(x * x2) THEN 0.125 ELSE 0.25 END::DOUBLE AS azimuth_ms FROM near GROUP BY track),
ps_bins AS (SELECT track, sum(p) AS total, sum(p) FILTER (bin <= 1) AS low, sum(p) FILTER (bin BETWEEN 3 AND 5) AS speech, sum(p) FILTER (bin BETWEEN 11 AND 13) AS ambient, exp(avg(ln(p)) FILTER (bin BETWEEN 1 AND 15)) / avg(p) FILTER (bin BETWEEN 1 AND 15) AS flat,
  sum(p) FILTER (bin = 4) AS p4, sum(p) FILTER (bin = 6) AS p6, avg(p) FILTER (bin IN (3, 5, 7)) AS beside, max(p) FILTER (bin BETWEEN 10 AND 15) / quantile_cont(p, 0.5) FILTER (bin BETWEEN 10 AND 15) AS line,
  max(p) FILTER (bin BETWEEN 2 AND 9) / quantile_cont(p, 0.5) FILTER (bin BETWEEN 2 AND 9) AS peak, arg_max(bin, p) FILTER (bin BETWEEN 2 AND 9) AS top FROM psd GROUP BY track),
ps_frames AS (SELECT track, sqrt(avg(x * x)) AS level FROM signal_long GROUP BY track, ix // {v.FRAME} HAVING count(*) = {v.FRAME}),
ps_levels AS (SELECT track, quantile_cont(level, 0.1) AS quiet, quantile_cont(level, 0.9) AS loud FROM ps_frames GROUP BY track),
profile AS (SELECT s.track AS id, coalesce(periodicity, 0) AS onset_periodicity, speech / total AS speech_ratio, 1 - flat AS music_ratio, ambient / total AS ambient_ratio, loud - quiet > 0.4 AS has_dialogue,
  20 * log10(loud / quiet) AS snr_db, round(balance_db, 6) AS balance_db, dc, declip, declick, azimuth_ms, CASE WHEN low / total > 0.3 THEN 75 WHEN low / total > 0.1 THEN 60 WHEN low / total > 0.02 THEN 45 ELSE 0 END AS highpass_hz,
  CASE WHEN greatest(p4, p6) > 1.3 * beside THEN CASE WHEN p4 >= p6 THEN 50.0 ELSE 60.0 END ELSE 0.0 END::DOUBLE AS notch_hz, CASE WHEN line >= 1.4 THEN 15625.0 ELSE 0.0 END::DOUBLE AS line_hz, CASE WHEN peak >= 1.5 THEN top * 110.0 ELSE 0.0 END::DOUBLE AS resonance_hz,
  20 * log10(quiet) AS floor_db FROM ps_samples s JOIN ps_bins USING (track) JOIN ps_levels USING (track) LEFT JOIN ({spans.SQL["onset_periodicity"]}) o USING (track))"""


def profile(spark, d):
    """One row a track: the readings that decide on its treatment."""
    x = layout.cut(v.signal_long(spark, d))
    near = layout.lagged(x, ["track"], x1=("x", 1), x2=("x", 2)).fillna(0.0, ["x1", "x2"])
    share = lambda c: F.avg(c.cast("int"))
    energy = lambda k: F.coalesce(F.sum(F.when(F.col("channel") == k, F.col("x") * F.col("x"))), F.lit(0.0)) + 1e-12
    one, two = F.sum(F.col("x") * F.col("x1")), F.sum(F.col("x") * F.col("x2"))
    samples = near.groupBy("track").agg(
        (F.abs(F.avg("x")) > 0.02).alias("dc"), (share(F.abs("x") >= 0.98) > 0.005).alias("declip"), (share(F.abs(F.col("x") - 2 * F.col("x1") + F.col("x2")) > 3.4) > 0.001).alias("declick"),
        F.round(10 * F.log10(energy(0) / energy(1)), 6).alias("balance_db"), F.when(F.greatest(one, two) <= 0, 0.0).when(one >= two, 0.125).otherwise(0.25).alias("azimuth_ms"),
    )
    bins = mean_spectrum(x)
    among = lambda lo, hi, c="p": F.when(F.col("bin").between(lo, hi), F.col(c))
    beside = F.avg(F.when(F.col("bin").isin(3, 5, 7), F.col("p")))
    p4, p6, total = F.sum(among(4, 4)), F.sum(among(6, 6)), F.sum("p")
    spectrum = bins.groupBy("track").agg(
        levels.rumble_highpass(F.sum(among(0, 1)) / total).alias("highpass_hz"), (F.sum(among(3, 5)) / total).alias("speech_ratio"), (F.sum(among(11, 13)) / total).alias("ambient_ratio"),
        (1 - F.exp(F.avg(F.log(among(1, 15)))) / F.avg(among(1, 15))).alias("music_ratio"), F.when(F.greatest(p4, p6) > 1.3 * beside, F.when(p4 >= p6, 50.0).otherwise(60.0)).otherwise(0.0).alias("notch_hz"),
        F.when(F.max(among(10, 15)) / F.percentile(among(10, 15), 0.5) >= 1.4, 15625.0).otherwise(0.0).alias("line_hz"),
        F.when(F.max(among(2, 9)) / F.percentile(among(2, 9), 0.5) >= 1.5, F.max_by("bin", among(2, 9)) * 110.0).otherwise(0.0).alias("resonance_hz"),
    )
    frames = v.levels(x)
    q = layout.quantiles(frames, ["track"], "level", quiet=0.1, loud=0.9)
    both = samples.join(spectrum, "track").join(q, "track").join(spans.periodicity(frames), "track", "left")
    readings = ["speech_ratio", "music_ratio", "ambient_ratio", "balance_db", "dc", "declip", "declick", "azimuth_ms", "highpass_hz", "notch_hz", "line_hz", "resonance_hz"]
    return both.select(
        F.col("track").alias("id"), F.coalesce("periodicity", F.lit(0.0)).alias("onset_periodicity"), (F.col("loud") - F.col("quiet") > 0.4).alias("has_dialogue"),
        (20 * F.log10(F.col("loud") / F.col("quiet"))).alias("snr_db"), (20 * F.log10("quiet")).alias("floor_db"), *readings,
    )


@query(f"WITH {PROFILE} SELECT id, round(onset_periodicity, 5) AS onset_periodicity, round(speech_ratio, 5) AS speech_ratio, round(music_ratio, 5) AS music_ratio, round(ambient_ratio, 5) AS ambient_ratio, has_dialogue, round(snr_db, 4) AS snr_db, round(balance_db, 4) AS balance_db, dc, declip, declick, azimuth_ms, highpass_hz, notch_hz, line_hz, resonance_hz, round(floor_db, 4) AS floor_db FROM profile")
def profile_row(spark, d):
    """The profile of each track, as the rules read it."""
    digits = {"onset_periodicity": 5, "speech_ratio": 5, "music_ratio": 5, "ambient_ratio": 5, "snr_db": 4, "balance_db": 4, "floor_db": 4}
    return profile(spark, d).withColumns({c: F.round(c, n) for c, n in digits.items()})


MATERIAL = PROFILE + """, kinds AS (SELECT *, CASE WHEN onset_periodicity >= 0.45 THEN 'rhythmic' WHEN speech_ratio >= 0.2 OR has_dialogue THEN 'dialogue'
  WHEN speech_ratio < 0.15 AND (music_ratio >= 0.15 OR ambient_ratio >= 0.15) THEN 'music' ELSE 'noise' END AS kind FROM profile)"""


@query(f"WITH {MATERIAL} SELECT id, kind FROM kinds")
def material_class(spark, d):
    return profile(spark, d).select("id", strategy.material().alias("kind"))


@query(f"""WITH {MATERIAL} SELECT id, kind, CASE kind WHEN 'rhythmic' THEN 'native' WHEN 'dialogue' THEN CASE WHEN snr_db < 10 THEN 'hybrid' ELSE 'linear' END WHEN 'music' THEN 'pure' ELSE 'denoise_only' END AS engine FROM kinds""")
def strategy_case(spark, d):
    p = profile(spark, d).withColumn("kind", strategy.material())
    return p.select("id", "kind", strategy.engine(F.col("kind"), F.col("snr_db")).alias("engine"))


@query(f"""WITH {PROFILE}, parts AS (SELECT id, list_filter([
  CASE WHEN dc THEN 'highpass=f=5' END,
  CASE WHEN abs(balance_db) > 25 THEN CASE WHEN balance_db > 0 THEN 'pan=stereo|c0=c0|c1=c0' ELSE 'pan=stereo|c0=c1|c1=c1' END
       WHEN abs(balance_db) > 0.5 AND abs(balance_db) <= 12 THEN printf('pan=stereo|c0=%.3f*c0|c1=%.3f*c1', pow(10, -balance_db / 40), pow(10, balance_db / 40)) END,
  CASE WHEN declip THEN 'adeclip' END,
  CASE WHEN azimuth_ms > 0 THEN printf('adelay=%.3f|0', azimuth_ms::DOUBLE) WHEN azimuth_ms < 0 THEN printf('adelay=0|%.3f', -azimuth_ms::DOUBLE) END,
  CASE WHEN highpass_hz > 0 THEN 'highpass=f=' || highpass_hz END,
  CASE WHEN declick THEN 'adeclick' END,
  CASE WHEN notch_hz > 0 THEN printf('bandreject=f=%.1f:width_type=q:w=15,bandreject=f=%.1f:width_type=q:w=15', notch_hz, notch_hz * 2) END,
  CASE WHEN line_hz > 0 THEN printf('bandreject=f=%.1f:width_type=q:w=30', line_hz) END,
  CASE WHEN resonance_hz > 0 THEN printf('bandreject=f=%.1f:width_type=q:w=12', resonance_hz) END], lambda p: p IS NOT NULL) AS p FROM profile)
SELECT id, CASE WHEN len(p) = 0 THEN 'anull' ELSE array_to_string(p, ',') END AS graph FROM parts""")
def filter_graph(spark, d):
    names = ["dc", "balance_db", "declip", "azimuth_ms", "highpass_hz", "declick", "notch_hz", "line_hz", "resonance_hz"]
    return profile(spark, d).select("id", strategy.graph(**{n: F.col(n) for n in names}).alias("graph"))


@query(f"""WITH {PROFILE}, k AS (SELECT id, greatest(least(floor_db + 6.0, -35.0), -60.0)::DOUBLE AS knee FROM profile), m AS (SELECT *, round_even((knee - 90) / 2, 1)::DOUBLE AS mid FROM k)
SELECT id, printf('-90/-100|%.1f/%.1f|%.1f/%.1f|0/0', mid, mid - 12, knee, knee) AS points FROM m""")
def expander_curve(spark, d):
    return profile(spark, d).select("id", strategy.expander_points(F.col("floor_db")).alias("points"))


ROUTE = v.POWER64 + """, shares AS (SELECT track, frame_ix, list_sum(p) AS total, list_sum(list_slice(p, 4, 9)) / list_sum(p) AS speech, list_sum(list_slice(p, 10, 21)) / list_sum(p) AS music FROM power64)"""


@query(f"""WITH {ROUTE} SELECT track, CASE WHEN total < 1e-6 THEN 'silence' WHEN speech >= 0.22 AND music >= 0.42 THEN 'mixed' WHEN speech >= 0.22 THEN 'speech' WHEN music >= 0.42 THEN 'music' ELSE 'mixed' END AS route, count(*) AS n FROM shares GROUP BY ALL""")
def route_window(spark, d):
    """Frames of each track by what most of their energy is."""
    p = v.frames64(spark, d).select("track", F.explode(F.array(levels.power_spectrum(F.col("x"), 64))).alias("p"))  # one power spectrum a row
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    shares = p.select("track", total(F.col("p")).alias("total"), total(F.slice("p", 4, 6)).alias("a"), total(F.slice("p", 10, 12)).alias("b"))
    speech, music = F.col("a") >= 0.22 * F.col("total"), F.col("b") >= 0.42 * F.col("total")
    route = F.when(F.col("total") < 1e-6, "silence").when(speech & music, "mixed").when(speech, "speech").when(music, "music").otherwise("mixed")
    return shares.groupBy("track", route.alias("route")).agg(F.count("*").alias("n"))


# scalar functions

@query("""WITH f AS (SELECT l_extendedprice / 5 AS hz, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem), e AS (SELECT *, 21.4 * log10(0.00437 * hz + 1) AS erb FROM f)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(erb, 6) AS erb, round((pow(10.0, erb / 21.4) - 1) / 0.00437, 4) AS back,
  round(13 * atan(0.00076 * hz) + 3.5 * atan(pow(hz / 7500, 2)), 6) AS bark, round(3.64 * pow(hz / 1000, -0.8) - 6.5 * exp(-0.6 * pow(hz / 1000 - 3.3, 2)) + 1e-3 * pow(hz / 1000, 4), 6) AS quiet_db FROM e""")
def hearing_scales(spark, d):
    hz = F.col("l_extendedprice") / 5
    f = v.table(spark, d, "lineitem").withColumn("erb", levels.erb_number(hz))
    return f.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("erb", 6).alias("erb"), F.round(levels.erb_to_hz(F.col("erb")), 4).alias("back"), F.round(levels.bark(hz), 6).alias("bark"), F.round(levels.quiet_threshold_db(hz), 6).alias("quiet_db"))


@query("""WITH g AS (SELECT event_id, value / 20 AS gamma, value / 60 + 0.05 AS xi FROM events), n AS (SELECT *, xi / (1 + xi) AS share, greatest(xi / (1 + xi) * gamma, 1e-10) AS x FROM g),
e AS (SELECT *, CASE WHEN x < 1 THEN -0.57721566 + x * (0.99999193 + x * (-0.24991055 + x * (0.05519968 + x * (-0.00976004 + x * 0.00107857)))) - ln(x)
  ELSE (0.2677737343 + x * (8.6347608925 + x * (18.0590169730 + x * (8.5733287401 + x)))) / (3.9584969228 + x * (21.0996530827 + x * (25.6329561486 + x * (9.5733223454 + x)))) / (x * exp(x)) END AS e1 FROM n)
SELECT event_id, round(share * exp(e1 / 2), 7) AS gain FROM e""")
def lsa_gain(spark, d):
    return v.table(spark, d, "events").select("event_id", F.round(levels.lsa_gain(F.col("value") / 20, F.col("value") / 60 + 0.05), 7).alias("gain"))


@query("""SELECT event_id, round(1 / (1 + exp(-(value / 50 - 1))), 8) AS p, round(-ln(least(greatest(1 / (1 + exp(-(value / 50 - 1))), 1e-12), 1 - 1e-12)), 7) AS loss FROM events""")
def sigmoid_log_loss(spark, d):
    p = levels.sigmoid(F.col("value") / 50 - 1)
    return v.table(spark, d, "events").select("event_id", F.round(p, 8).alias("p"), F.round(levels.log_loss(p, F.lit(1.0)), 7).alias("loss"))


@query(r"""SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.\-]', '_', 'g') AS name FROM pages""")
def safe_name(spark, d):
    return v.table(spark, d, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


@query(r"""SELECT doc_id, md5(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g')) AS line FROM documents""")
def one_line(spark, d):
    return v.table(spark, d, "documents").select("doc_id", F.md5(text.one_line(F.col("text"))).alias("line"))


@query(r"""SELECT item_id, trim(regexp_replace(regexp_replace(translate(lower(text), 'şţ', 'șț'), '[!-/:-@\[-`{-~]', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS norm FROM benchmark""")
def text_normalise(spark, d):
    return v.table(spark, d, "benchmark").select("item_id", text.normalised(F.col("text")).alias("norm"))


# levenshtein counts bytes in the SQL: each letter beyond ASCII becomes a control character of its own there
SINGLE = " || ".join(f"chr({k})" for k in (*range(1, 9), *range(14, 32)))


@query(rf"""WITH letters AS (SELECT coalesce(string_agg(DISTINCT c, '' ORDER BY c), '') AS l FROM (SELECT unnest(regexp_extract_all(text, '[^\x00-\x7F]')) AS c FROM conversations)),
a AS (SELECT conv_id, turn, role, text, translate(text, l, {SINGLE}) AS bytes FROM conversations, letters),
t AS (SELECT conv_id, turn, bytes, lag(bytes) OVER w AS ref FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, turn, round(CASE WHEN length(ref) = 0 THEN CASE WHEN length(bytes) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein(ref, bytes) / length(ref) END, 6) AS cer FROM t WHERE ref IS NOT NULL""")
def edit_distance_cer(spark, d):
    """Character error rate (code points) of each turn against the turn before; a conversation's turns are few."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = v.table(spark, d, "conversations").withColumn("ref", F.lag("text").over(w)).where(F.col("ref").isNotNull())
    return t.select("conv_id", "turn", F.round(text.error_rate(F.col("ref"), F.col("text")), 6).alias("cer"))


@query("""WITH s AS (SELECT event_id, round(value * 100)::BIGINT AS cs, value FROM events)
SELECT event_id, printf('%02d:%02d:%02d.%02d', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) AS clock, round(cs / 100, 2) AS seconds FROM s""")
def time_format(spark, d):
    e = v.table(spark, d, "events").select("event_id", text.clock(F.col("value")).alias("clock"))
    return e.withColumn("seconds", F.round(text.parsed_clock(F.concat(F.lit("time="), "clock")), 2))


@query("""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN strftime(o_orderdate, '%Y-02-%d') ELSE strftime(o_orderdate, '%Y-%m') END AS x FROM orders)
SELECT o_orderkey, x, coalesce(strftime(try_cast(CASE WHEN regexp_full_match(x, '\\d{4}-\\d\\d-\\d\\d') THEN x END AS DATE), '%Y-%m-%d') = x, false) AS valid FROM s""")
def iso_date_check(spark, d):
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    x = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyy/MM/dd")).when(k == 2, F.date_format(day, "yyyy-'02'-dd")).otherwise(F.date_format(day, "yyyy-MM"))
    o = v.table(spark, d, "orders").select("o_orderkey", x.alias("x"))
    return o.withColumn("valid", text.is_iso_date(F.col("x")))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hash(spark, d):
    return v.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("""SELECT p_partkey, sha256('{"brand":"' || p_brand || '","size":' || p_size || ',"type":"' || p_type || '"}') AS key FROM part""")
def canonical_json_key(spark, d):
    """Content key of a record: a digest of its JSON with sorted keys and no spaces."""
    p = v.table(spark, d, "part")
    return p.select("p_partkey", F.sha2(F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_type").alias("type"))), 256).alias("key"))


@query("SELECT event_type, json_extract(props, '$.k')::INTEGER AS k, count(*) AS n FROM events GROUP BY ALL")
def json_extract(spark, d):
    e = v.table(spark, d, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"))


# sets of records

@query("SELECT DISTINCT lang AS label FROM documents UNION SELECT DISTINCT source FROM documents")
def label_union(spark, d):
    t = v.table(spark, d, "documents")
    return t.select(F.col("lang").alias("label")).union(t.select("source")).distinct()


@query("SELECT c_nationkey AS clip FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def common_clips(spark, d):
    return v.table(spark, d, "customer").select(F.col("c_nationkey").alias("clip")).intersect(v.table(spark, d, "supplier").where("s_acctbal > 0").select("s_nationkey"))


@query("""SELECT s_nationkey AS nation, bool_and(EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_mktsegment = seg)) AS covers
FROM (SELECT DISTINCT s_nationkey FROM supplier) CROSS JOIN (VALUES ('BUILDING'), ('MACHINERY'), ('HOUSEHOLD')) t(seg) GROUP BY s_nationkey""")
def covers(spark, d):
    """Whether each nation with suppliers has customers of all wanted segments."""
    wanted = F.array(*[F.lit(x) for x in ("BUILDING", "MACHINERY", "HOUSEHOLD")])
    have = v.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.collect_set("c_mktsegment").alias("have"))
    s = v.table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")).distinct()
    return s.join(have, "nation", "left").select("nation", (F.size(F.array_except(wanted, F.coalesce("have", F.array().cast("array<string>")))) == 0).alias("covers"))


@query("SELECT text_id AS digest, count(*) AS n FROM (SELECT md5(text) AS text_id FROM documents) GROUP BY text_id HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return v.table(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n")).where(F.col("n") > 1)


@query("""SELECT p_name AS name, count(DISTINCT p_type) AS kinds FROM part GROUP BY p_name HAVING count(DISTINCT p_type) > 1""")
def label_conflicts(spark, d):
    """Names that stand for different things."""
    return v.table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.countDistinct("p_type").alias("kinds")).where(F.col("kinds") > 1)


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_present(spark, d):
    o = v.table(spark, d, "orders").where("o_orderstatus = 'P'")
    return v.table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def anti_pending(spark, d):
    return v.table(spark, d, "documents").join(v.table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("""WITH fresh AS (SELECT doc_id, 'toxic' AS family, toxic AS value FROM labels WHERE doc_id % 2 = 0), stored AS (SELECT doc_id, 'toxic' AS family, 0 AS value FROM labels UNION ALL SELECT doc_id, 'quality', quality FROM labels)
SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.doc_id = s.doc_id AND f.family = s.family) UNION ALL SELECT * FROM fresh""")
def merge_families(spark, d):
    """Stored readings, those of a family and document that were read again replaced."""
    lab = v.table(spark, d, "labels")
    fresh = lab.where(F.col("doc_id") % 2 == 0).select("doc_id", F.lit("toxic").alias("family"), F.col("toxic").alias("value"))
    stored = lab.select("doc_id", F.lit("toxic").alias("family"), F.lit(0).alias("value")).unionByName(lab.select("doc_id", F.lit("quality").alias("family"), F.col("quality").alias("value")))
    return stored.join(fresh, ["doc_id", "family"], "left_anti").unionByName(fresh)


@query("""WITH tiers AS (SELECT source AS tape, quality + (1 - toxic) AS tier, count(*) AS n, min(doc_id) AS sample FROM labels JOIN documents USING (doc_id) GROUP BY ALL)
SELECT a.tape, b.tier AS better, a.tier AS worse, b.sample AS better_id, a.sample AS worse_id, (a.n * b.n)::BIGINT AS pairs FROM tiers a JOIN tiers b ON a.tape = b.tape AND a.tier < b.tier""")
def preference_pairs(spark, d):
    """Pairs across tiers of each tape, by tier: how many there are and one of each; all pairs are never written out."""
    j = v.table(spark, d, "labels").join(v.table(spark, d, "documents").select("doc_id", F.col("source").alias("tape")), "doc_id")
    t = j.groupBy("tape", (F.col("quality") + 1 - F.col("toxic")).alias("tier")).agg(F.count("*").alias("n"), F.min("doc_id").alias("sample"))
    a, b = t.alias("a"), t.alias("b")
    p = a.join(b, (F.col("a.tape") == F.col("b.tape")) & (F.col("a.tier") < F.col("b.tier")))
    return p.select("a.tape", F.col("b.tier").alias("better"), F.col("a.tier").alias("worse"), F.col("b.sample").alias("better_id"), F.col("a.sample").alias("worse_id"), (F.col("a.n") * F.col("b.n")).alias("pairs"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""")
def latest_result(spark, d):
    """The latest record of each key, as a checkpointed sink keeps it."""
    best = v.table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("m"))
    return best.select("o_custkey", "m.o_orderkey", "m.o_totalprice")


@query("""SELECT source, lang, count(*) AS n, count_if(quality = 0) AS failed, count_if(toxic = 1) AS tripped FROM documents JOIN labels USING (doc_id) GROUP BY CUBE (source, lang) HAVING grouping(source) = 0 OR grouping(lang) = 0""")
def conditional_counts(spark, d):
    j = v.table(spark, d, "documents").select("doc_id", "source", "lang").join(v.table(spark, d, "labels"), "doc_id")
    c = j.cube("source", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("failed"), F.count_if(F.col("toxic") == 1).alias("tripped"), F.grouping_id().alias("g"))
    return c.where(F.col("g") < 3).drop("g")
