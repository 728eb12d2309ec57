"""The operators over the standard tables, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.mathx import round_half_away
from quillspark.operators import calibrate as C
from quillspark.operators import clones, delta, detectors, paths, rollup, score
from quillspark.sources import prose
from quillspark.sources.config import Config

WEIGHTS = Config().weights
AS_OF, WINDOW_DAYS = "2024-01-30 00:00:00", 7

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micro(x):
    return round_half_away(x, 6)


# ---------------------------------------------------------------- SQL fragments

#: erf by its Kummer series, independent of the approximation used on Spark
ERF = "(CASE WHEN abs({x}) >= 6 THEN sign({x}) ELSE 2/sqrt(pi())*exp(-({x})*({x}))*({x})*list_reduce(list_concat([1.0::DOUBLE], range(140, 0, -1)::DOUBLE[]), lambda a, k: 1 + 2*({x})*({x})/(2*k+1)*a) END)"


def norm_sql(raw: str, mu: str, sigma: str, valid: str) -> str:
    z = f"((ln({raw})-{mu})/{sigma}/sqrt(2.0))"
    return f"(CASE WHEN {valid} AND {raw} > 0 THEN greatest(0.0, least(1.0, (0.5*(1+{ERF.format(x=z)})-0.3)/0.7)) ELSE 0.0 END)"


OCC_SQL = """occ AS (
  SELECT doc_id, md5(line) AS digest, length(line)::INT AS size, pos FROM (
    SELECT doc_id, trim(unnest(l), ' ') AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(coalesce(text,''), chr(10)) AS l FROM documents))
  WHERE length(line) >= 12)"""
INTRA_SQL = """intra AS (SELECT doc_id, sum((n-1)*size)::BIGINT AS mass FROM (SELECT doc_id, digest, count(*) n, max(size) size FROM occ GROUP BY 1,2) WHERE n >= 2 GROUP BY 1)"""
CROSS_SQL = """shared AS (SELECT digest, min(doc_id) AS original FROM occ GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2),
crossed AS (SELECT doc_id, sum(size)::BIGINT AS mass FROM (SELECT o.doc_id, o.digest, max(o.size) size FROM occ o JOIN shared s USING (digest) WHERE o.doc_id <> s.original GROUP BY 1,2) GROUP BY 1)"""
FEATURE_SQL = f"""{OCC_SQL}, {INTRA_SQL}, {CROSS_SQL},
feats AS (
  SELECT d.doc_id, len(regexp_extract_all(coalesce(text,''), '[.!?]'))::BIGINT AS cyclomatic,
    list_max(list_transform(string_split(coalesce(text,''), chr(10)), lambda x: length(x)-length(replace(x, ',', ''))))::BIGINT AS nesting,
    len(regexp_extract_all(coalesce(text,''), '[;:|]'))::BIGINT AS coupling,
    len(list_filter(string_split(coalesce(text,''), chr(10)), lambda x: trim(x, ' ') <> ''))::BIGINT AS length,
    coalesce(i.mass, 0)::BIGINT AS duplication, coalesce(c.mass, 0)::BIGINT AS cross_duplication
  FROM documents d LEFT JOIN intra i USING (doc_id) LEFT JOIN crossed c USING (doc_id))"""
LONG_SQL = "long AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS name, {n}::DOUBLE AS raw FROM feats" for n in C.FEATURES) + ")"
PARAM_SQL = """params AS (SELECT name, n, CASE WHEN ok THEN mu ELSE 0.0 END mu, CASE WHEN ok THEN sigma ELSE 0.0 END sigma, ok AS valid FROM (
  SELECT name, n, mu, sigma, coalesce(n >= 2 AND hi > lo AND sigma > 0, false) ok FROM (
    SELECT name, count(*) FILTER (raw > 0) n, avg(ln(raw)) FILTER (raw > 0) mu, stddev_pop(ln(raw)) FILTER (raw > 0) sigma, min(raw) FILTER (raw > 0) lo, max(raw) FILTER (raw > 0) hi FROM long GROUP BY 1)))"""
WEIGHT_SQL = "w AS (SELECT * FROM (VALUES " + ",".join(f"('{n}', {WEIGHTS[n]}::DOUBLE, {i})" for i, n in enumerate(C.FEATURES)) + ") t(name, weight, ord))"
PART_SQL = f"""parts AS (SELECT doc_id, name, ord, weight * ln(1 + {norm_sql('raw', 'mu', 'sigma', 'valid')}) AS c FROM long JOIN params USING (name) JOIN w USING (name)),
k AS (SELECT CASE WHEN m > 0 THEN 1/m ELSE 1.0 END AS k FROM (SELECT median(c) m FROM (SELECT doc_id, sum(c ORDER BY ord) c FROM parts GROUP BY 1)))"""
CHURN_SQL = f"""churn AS (SELECT user_id, count(DISTINCT event_id) AS churn FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL {WINDOW_DAYS} DAY AND ts < TIMESTAMP '{AS_OF}' GROUP BY 1)"""
SCORE_SQL = f"""WITH {FEATURE_SQL}, {LONG_SQL}, {PARAM_SQL}, {WEIGHT_SQL}, {PART_SQL}, {CHURN_SQL},
scored AS (SELECT doc_id, sum(k * c ORDER BY ord) s, coalesce(arg_max(name, c - ord * 1e-13) FILTER (c > 0), '') dominant FROM parts, k GROUP BY 1),
scores AS (SELECT doc_id, s, s * (1 + 0.5 * ln(1 + coalesce(churn, 0))) t, dominant FROM scored LEFT JOIN churn ON churn.user_id = scored.doc_id)"""

# ---------------------------------------------------------------- scan


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, features, contributions, s, t, dominant; churn is taken from events by user."""
    feats = prose.features(table(spark, sf_dir, "documents")).cache()  # read for the fit, for k and for the scores
    cal = C.calibrate(feats, "doc_id", WEIGHTS)
    churn = score.churn_counts(table(spark, sf_dir, "events"), "user_id", "ts", AS_OF, WINDOW_DAYS, "event_id")
    return score.score(feats.join(churn, F.col("doc_id") == F.col("user_id"), "left"), cal, WEIGHTS, churn="churn")


@query(f"{SCORE_SQL} SELECT doc_id, round(s*1e6)/1e6 AS s, round(t*1e6)/1e6 AS t, dominant FROM scores")
def scan_hotspots(spark, sf_dir):
    scores = document_scores(spark, sf_dir)
    return score.rank(scores.select("doc_id", micro(F.col("s")).alias("s"), micro(F.col("t")).alias("t"), "dominant"), "doc_id")


@query(f"{SCORE_SQL} SELECT doc_id, round(t*1e6)/1e6 AS t FROM scores ORDER BY round(t*1e6) DESC, doc_id LIMIT 20")
def top_k(spark, sf_dir):
    scores = document_scores(spark, sf_dir)
    return score.rank(scores.select("doc_id", micro(F.col("t")).alias("t")), "doc_id", top=20)


@query(f"{SCORE_SQL} SELECT CASE WHEN dominant = '' THEN 'none' ELSE dominant END AS dominant, count(*) AS n_units FROM scores GROUP BY 1")
def dominant_hist(spark, sf_dir):
    return score.dominant_histogram(document_scores(spark, sf_dir))


@query(f"{SCORE_SQL} SELECT doc_id, CASE WHEN t >= 1.5 THEN 'warning' ELSE 'note' END AS level FROM scores WHERE t >= 1.0")
def sarif_bands(spark, sf_dir):
    level = rollup.bands(F.col("t"))
    return document_scores(spark, sf_dir).select("doc_id", level.alias("level")).where(F.col("level").isNotNull())


@query(f"WITH {FEATURE_SQL} SELECT * FROM feats")
def prose_features(spark, sf_dir):
    return prose.features(table(spark, sf_dir, "documents"))


@query(f"WITH {FEATURE_SQL}, {LONG_SQL}, {PARAM_SQL} SELECT name, n, round(mu*1e6)/1e6 AS mu, round(sigma*1e6)/1e6 AS sigma, valid FROM params")
def calibrate_params(spark, sf_dir):
    feats = prose.features(table(spark, sf_dir, "documents"))
    fits = C.fit_params(C.to_long(feats, "doc_id", list(C.FEATURES)))
    return fits.select("name", "n", micro(F.col("mu")).alias("mu"), micro(F.col("sigma")).alias("sigma"), "valid")


@query(f"WITH {FEATURE_SQL}, {LONG_SQL}, {PARAM_SQL}, {WEIGHT_SQL}, {PART_SQL} SELECT round(k*1e6)/1e6 AS k FROM k")
def calibrate_k(spark, sf_dir):
    feats = prose.features(table(spark, sf_dir, "documents")).cache()
    cal = C.calibrate(feats, "doc_id", WEIGHTS)
    return spark.createDataFrame([(cal.k,)], "k double").select(micro(F.col("k")).alias("k"))


@query(f"""WITH p AS (SELECT avg(ln(o_totalprice)) mu, stddev_pop(ln(o_totalprice)) sigma FROM orders WHERE o_totalprice > 0)
SELECT o_orderkey, round({norm_sql('o_totalprice', 'mu', 'sigma', 'true')}*1e6)/1e6 AS norm FROM orders, p""")
def normalize_cdf(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    fit = C.fit(orders.select(F.lit("price").alias("name"), F.col("o_totalprice").alias("raw")))["price"]
    return orders.select("o_orderkey", micro(C.normalize(F.col("o_totalprice"), fit)).alias("norm"))


@query(f"WITH {CHURN_SQL} SELECT u.user_id, coalesce(churn, 0)::BIGINT AS churn, round((1 + 0.5*ln(1 + coalesce(churn, 0)))*1e6)/1e6 AS factor FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN churn USING (user_id)")
def temperature(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    churn = score.churn_counts(events, "user_id", "ts", AS_OF, WINDOW_DAYS, "event_id")
    all_users = events.select("user_id").distinct().join(churn, "user_id", "left")
    return all_users.select("user_id", F.coalesce("churn", F.lit(0)).cast("long").alias("churn"), micro(score.churn_factor(F.col("churn"), C.ALPHA)).alias("factor"))


@query("SELECT doc_id, len(list_filter(string_split(coalesce(text,''), chr(10)), lambda x: trim(x, ' ') <> ''))::BIGINT AS length FROM documents")
def length_lines(spark, sf_dir):
    return prose_features(spark, sf_dir).select("doc_id", "length")


@query("SELECT page_id, len(regexp_extract_all(html, 'href='))::BIGINT AS coupling FROM pages")
def coupling_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit("href=")).cast("long").alias("coupling"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[.!?]'))::BIGINT AS cyclomatic FROM documents")
def decision_points(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit("[.!?]")).cast("long").alias("cyclomatic"))


# ---------------------------------------------------------------- clones


@query(f"WITH {OCC_SQL}, {INTRA_SQL} SELECT * FROM intra")
def intra_dup(spark, sf_dir):
    return clones.intra_mass(prose.line_occurrences(table(spark, sf_dir, "documents")), ["doc_id"])


@query(f"WITH {OCC_SQL}, {CROSS_SQL} SELECT * FROM crossed")
def cross_dup(spark, sf_dir):
    return clones.cross_mass(prose.line_occurrences(table(spark, sf_dir, "documents")), "doc_id")


@query(f"WITH {OCC_SQL} SELECT digest, count(*) AS n, count(DISTINCT doc_id) AS n_units, min(doc_id) AS original, max(size) AS size FROM occ GROUP BY 1 HAVING count(*) >= 2")
def clone_index(spark, sf_dir):
    return clones.clone_classes(prose.line_occurrences(table(spark, sf_dir, "documents")), "doc_id").select("digest", "n", "n_units", "original", "size")


_SPANS = "SELECT user_id, event_id, (event_id // 64) * 64 + (event_id % 64) // 8 * (CASE WHEN event_id % 3 = 0 THEN 0 ELSE 8 END) AS pos, (event_id // 64) * 64 + 63 - (CASE WHEN event_id % 3 = 0 THEN 0 ELSE (7 - (event_id % 64) // 8) * 8 END) AS \"end\" FROM events"


@query(f"""WITH e AS ({_SPANS}), s AS (SELECT DISTINCT user_id, pos, "end" FROM e)
SELECT a.user_id, a.pos::BIGINT AS pos, a."end"::BIGINT AS "end" FROM s a WHERE NOT EXISTS (
  SELECT 1 FROM s b WHERE b.user_id = a.user_id AND b.pos <= a.pos AND b."end" >= a."end" AND (b.pos, b."end") <> (a.pos, a."end"))""")
def outermost(spark, sf_dir):
    block = F.floor(F.col("event_id") / 64) * 64
    eighth = F.floor(F.pmod("event_id", F.lit(64)) / 8)
    whole = F.col("event_id") % 3 == 0
    spans = table(spark, sf_dir, "events").select(
        "user_id",
        (block + eighth * F.when(whole, 0).otherwise(8)).cast("long").alias("pos"),
        (block + 63 - F.when(whole, 0).otherwise((7 - eighth) * 8)).cast("long").alias("end"),
    )
    rows = spans.distinct().withColumn("size", F.col("end") - F.col("pos")).withColumn("digest", F.lit(""))
    return clones.outermost(rows, ["user_id"]).select("user_id", "pos", "end")


# ---------------------------------------------------------------- delta, gate, history

_YEARS = """b AS (SELECT o_custkey, sum(ln(1+o_totalprice)) s FROM orders WHERE year(o_orderdate)=2000 GROUP BY 1), h AS (SELECT o_custkey, sum(ln(1+o_totalprice)) s FROM orders WHERE year(o_orderdate)=2001 GROUP BY 1),
d AS (SELECT coalesce(b.o_custkey, h.o_custkey) o_custkey, CASE WHEN b.s IS NULL THEN 'added' WHEN h.s IS NULL THEN 'removed' ELSE 'modified' END kind, coalesce(b.s,0) s_base, coalesce(h.s,0) s_head, coalesce(h.s,0)-coalesce(b.s,0) delta FROM b FULL JOIN h ON b.o_custkey=h.o_custkey)"""


def _year_deltas(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), F.log1p("o_totalprice").alias("v"))
    of = lambda y: orders.where(F.col("y") == y).groupBy("o_custkey").agg(F.sum("v").alias("s"))
    return delta.file_deltas(of(2000), of(2001), "o_custkey")


@query(f"WITH {_YEARS} SELECT o_custkey, kind, round(s_base*1e6)/1e6 AS s_base, round(s_head*1e6)/1e6 AS s_head, round(delta*1e6)/1e6 AS delta FROM d")
def delta_files(spark, sf_dir):
    return _year_deltas(spark, sf_dir).select("o_custkey", "kind", *(micro(F.col(c)).alias(c) for c in ("s_base", "s_head", "delta")))


@query(f"WITH {_YEARS} SELECT round(sum(delta)*1e4)/1e4 AS total, round(sum(delta)/greatest(1, count(*))*1e6)/1e6 AS density, count(*) AS lines_changed, count(*) AS n_files FROM d")
def delta_total(spark, sf_dir):
    sums = delta.total(_year_deltas(spark, sf_dir).withColumn("one", F.lit(1)), F.col("one"))
    return sums.select(round_half_away(F.col("total"), 4).alias("total"), micro(F.col("density")).alias("density"), "lines_changed", "n_files")


@query(f"""WITH {_YEARS}, t AS (SELECT sum(delta)/greatest(1, count(*)) density FROM d), c AS (SELECT max(o_orderstatus) st, 2 AS cls FROM orders)
SELECT lim AS "limit", density > lim OR cls > top AS failed, array_to_string(list_filter([CASE WHEN density > lim THEN 'delta_s' END, CASE WHEN cls > top THEN 'scaling O(n)' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM t, c, (VALUES (-100.0::DOUBLE, 1), (-100.0, 2), (100.0, 1), (100.0, 2)) v(lim, top)""")
def gate_verdict(spark, sf_dir):
    sums = delta.total(_year_deltas(spark, sf_dir).withColumn("one", F.lit(1)), F.col("one"))
    out = None
    for limit in (-100.0, 100.0):
        for top in (1, 2):
            row = delta.verdict(sums, F.lit(2), limit, top).select(F.lit(limit).alias("limit"), "failed", F.array_join("reasons", ",").alias("reasons"))
            out = row if out is None else out.unionByName(row)
    return out


_STATUS = "CASE event_type WHEN 'view' THEN 'M' WHEN 'signup' THEN 'A' WHEN 'purchase' THEN 'R087' WHEN 'error' THEN 'D' ELSE 'C100' END"


@query(f"SELECT CASE left(st,1) WHEN 'A' THEN 'added' WHEN 'D' THEN 'removed' WHEN 'R' THEN 'renamed' WHEN 'C' THEN 'renamed' ELSE 'modified' END AS kind, count(*) AS n FROM (SELECT {_STATUS} st FROM events) GROUP BY 1")
def classify_change(spark, sf_dir):
    return table(spark, sf_dir, "events").select(paths.classify_change(F.expr(_STATUS)).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN a='160000' OR b='160000' THEN 'submodule' WHEN a='120000' OR b='120000' THEN 'symlink' WHEN bin THEN 'binary' WHEN x=y AND a<>b THEN 'mode_only' END AS reason FROM (
SELECT event_id, CASE event_id % 5 WHEN 0 THEN '160000' WHEN 1 THEN '120000' ELSE '100644' END a, CASE event_id % 7 WHEN 0 THEN '100755' ELSE '100644' END b, event_id % 11 = 0 bin, event_id % 3 x, event_id % 2 y FROM events)""")
def classify_skip(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    a = F.when(i % 5 == 0, "160000").when(i % 5 == 1, "120000").otherwise("100644")
    b = F.when(i % 7 == 0, "100755").otherwise("100644")
    return e.select("event_id", paths.classify_skip(a, b, i % 3, i % 2, i % 11 == 0).alias("reason"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS frame, round(sum(ln(1+o_totalprice))*1e4)/1e4 AS s, count(*) AS n_files FROM orders GROUP BY 1")
def history_series(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("frame"), F.log1p("o_totalprice").alias("s"))
    return rollup.series(orders, ["frame"]).select("frame", round_half_away(F.col("s"), 4).alias("s"), "n_files")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS frame, count(*) AS n_files FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 30")
def history_newest(spark, sf_dir):
    months = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("frame")).agg(F.count("*").alias("n_files"))
    return rollup.newest_then_ascending(months, "frame", 30)


# ---------------------------------------------------------------- rollups, heat


@query("""SELECT r_name, n_name, round(sum(c_acctbal)*100)/100 AS s, count(*) AS n FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def package_rollup(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rollup.package_rollup(rows, ["r_name", "n_name"], "c_acctbal").select("r_name", "n_name", round_half_away(F.col("s"), 2).alias("s"), "n")


_URL = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query(f"""WITH p AS (SELECT {_URL} AS path, length(html)/4000.0::DOUBLE AS s FROM pages), q AS (SELECT string_split(path, '/') parts, s FROM p),
x AS (SELECT array_to_string(parts[1:i], '/') AS dir, greatest(s, 0.05) w FROM (SELECT parts, s, unnest(range(len(parts))) i FROM q))
SELECT dir, round(sum(w)*1e6)/1e6 AS weight, count(*) AS n_files FROM x GROUP BY 1""")
def directory_weights(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.expr(_URL).alias("path"), (F.length("html") / F.lit(4000.0)).alias("s"))
    return rollup.directory_weights(pages).select("dir", micro(F.col("weight")).alias("weight"), "n_files")


@query("""WITH p AS (SELECT quantile_disc(c_acctbal, 0.95) p95 FROM customer)
SELECT c_custkey, round(120*(1-greatest(0.0, least(1.0, CASE WHEN p95 > 0 THEN c_acctbal/p95 ELSE 1.0 END)))*1e6)/1e6 AS hue FROM customer, p""")
def heat_scale(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    p95 = rollup.nearest_rank(c, "c_acctbal", 0.95)
    return c.crossJoin(F.broadcast(p95)).select("c_custkey", micro(rollup.heat_hue(F.col("c_acctbal"), F.col("p"))).alias("hue"))


@query(f"""{SCORE_SQL}, placed AS (SELECT lang, source, greatest(s, 0.05) AS w FROM scores JOIN documents USING (doc_id)),
x AS (SELECT '' AS dir, w FROM placed UNION ALL SELECT lang, w FROM placed UNION ALL SELECT lang || '/' || source, w FROM placed)
SELECT dir, round(sum(w) * 1e4) / 1e4 AS weight, count(*) AS n_files FROM x GROUP BY 1""")
def treemap_rollup(spark, sf_dir):
    """The weights of the treemap's directories: languages, then sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "source", "doc_id").alias("path"))
    by = rollup.directory_weights(document_scores(spark, sf_dir).select("doc_id", "s").join(docs, "doc_id"))
    return by.select("dir", round_half_away(F.col("weight"), 4).alias("weight"), "n_files")


@query()
def treemap_layout(spark, sf_dir):
    """Rectangles of the sources by S: one row a source reaches the driver, as in the report."""
    from quillspark.reports.html import layout

    scores = document_scores(spark, sf_dir).select("doc_id", "s", "t")
    by = scores.join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    rows = by.groupBy(F.concat_ws("/", "lang", "source").alias("path")).agg(F.sum("s").alias("s"), F.max("t").alias("t")).collect()
    cells = [(c["path"], *(round(c[k], 3) for k in "xywh")) for c in layout([r.asDict() for r in rows])]
    return spark.createDataFrame(cells, "path string, x double, y double, w double, h double")


# ---------------------------------------------------------------- detectors


@query("""WITH f AS (SELECT doc_id, sha256(array_to_string(list_transform(list_sort(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')), lambda x: '+' || x || chr(10)), '')) fp FROM documents)
SELECT doc_id, fp, size FROM f JOIN (SELECT fp, count(*) size FROM f GROUP BY 1 HAVING count(*) >= 3) USING (fp)""")
def shotgun_groups(spark, sf_dir):
    patch = F.concat(F.lit("+"), F.regexp_replace("text", "\n", "\n+"))
    prints = table(spark, sf_dir, "documents").select(F.col("doc_id"), detectors.fingerprint(patch).alias("fp"))
    return detectors.shotgun_groups(prints, 3).select("doc_id", "fp", "size")


@query("SELECT l_partkey, total, touched FROM (SELECT l_partkey, count(*) total, sum((l_shipdate >= TIMESTAMP '1997-01-01')::INT)::BIGINT touched FROM lineitem GROUP BY 1) WHERE total >= 8 AND touched >= total * 0.8")
def fanout_ratio(spark, sf_dir):
    sites = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).alias("touched"))
    return detectors.touched_ratio(sites, ["l_partkey"], 8, 0.8)


@query("""WITH e AS (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= 2), s AS (SELECT p_brand, p_partkey, max((l_shipdate >= TIMESTAMP '2001-10-01')::INT) t FROM part JOIN lineitem ON p_partkey = l_partkey JOIN e USING (p_brand) GROUP BY 1, 2)
SELECT p_brand, count(*) AS total, sum(t)::BIGINT AS touched FROM s GROUP BY 1 HAVING count(*) >= 2 AND sum(t) >= count(*) * 0.2""")
def switch_symmetry(spark, sf_dir):
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_shipdate") >= F.lit("2001-10-01").cast("timestamp_ntz")).alias("t"))
    brands = p.groupBy("p_brand").agg(F.count("*").alias("n")).where("n >= 2")
    sites = p.join(brands, "p_brand", "left_semi").join(li, p.p_partkey == li.l_partkey).groupBy("p_brand", "p_partkey").agg(F.max("t").alias("touched"))
    return detectors.touched_ratio(sites, ["p_brand"], 2, 0.2)


@query("""WITH need AS (SELECT DISTINCT p_brand AS iface_id, p_size % 5 AS name FROM part), have AS (SELECT DISTINCT l_suppkey AS type_id, p_brand, p_size % 5 AS name FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT h.p_brand AS iface_id, h.type_id FROM have h JOIN need n ON n.iface_id = h.p_brand AND n.name = h.name GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM need WHERE iface_id = h.p_brand)""")
def implementor_division(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") % 5).cast("string").alias("name"))
    required = p.select(F.col("p_brand").alias("iface_id"), "name", F.col("p_brand").alias("sig"))
    li = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("type_id"))
    methods = li.join(p, li.l_partkey == p.p_partkey).select("type_id", "name", F.col("p_brand").alias("sig"))
    return detectors.implementors(required, methods)


@query("""WITH need AS (SELECT DISTINCT p_brand AS iface_id, p_size % 5 AS name FROM part), have AS (SELECT DISTINCT l_suppkey AS type_id, p_brand, p_size % 5 AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
pairs AS (SELECT h.p_brand AS iface_id, h.type_id FROM have h JOIN need n ON n.iface_id = h.p_brand AND n.name = h.name GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM need WHERE iface_id = h.p_brand))
SELECT iface_id, count(*) AS total, sum((s_acctbal > 0)::INT)::BIGINT AS touched FROM pairs JOIN supplier ON s_suppkey = type_id GROUP BY 1 HAVING count(*) >= 2 AND sum((s_acctbal > 0)::INT) >= 0.5 * count(*)""")
def implementor_ratio(spark, sf_dir):
    """Brands as interfaces, most of whose implementors (suppliers) are touched (in credit)."""
    touched = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("type_id"), (F.col("s_acctbal") > 0).alias("touched"))
    return detectors.touched_ratio(implementor_division(spark, sf_dir).join(touched, "type_id"), ["iface_id"], 2, 0.5)


@query("""WITH sym AS (SELECT p_partkey, p_name FROM part WHERE p_retailprice > 901 AND p_size >= 5 AND p_size > 10), u AS (SELECT l_partkey, l_suppkey, s_acctbal > 0 AS t FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
SELECT 'p' || p_partkey || '.go' AS path, 1 AS class, count(*) AS size, p_name || ': ' || sum(t::INT) || ' of ' || count(*) || ' uses touched' AS evidence FROM sym JOIN u ON l_partkey = p_partkey GROUP BY p_partkey, p_name HAVING count(*) >= 8 AND sum(t::INT) >= 0.8 * count(*)""")
def identifier_fanout(spark, sf_dir):
    """The whole detector: parts are symbols, small ones of another kind, cheap ones not exported; suppliers' files use them."""
    part, li, supp = (table(spark, sf_dir, t) for t in ("part", "lineitem", "supplier"))
    of = lambda kind, key: F.concat(F.lit(kind), key, F.lit(".go"))
    kind = F.when(F.col("p_size") < 5, "label").when(F.col("p_size") < 20, "func").when(F.col("p_size") < 30, "type").when(F.col("p_size") < 40, "var").otherwise("const")
    symbols = part.select(F.col("p_partkey").cast("string").alias("id"), F.lit("p").alias("pkg"), F.col("p_name").alias("name"), kind.alias("kind"), (F.col("p_retailprice") > 901).alias("exported"), of("p", "p_partkey").alias("path"))
    uses = li.select(F.col("l_partkey").cast("string").alias("symbol_id"), F.lit("s").alias("pkg"), of("s", "l_suppkey").alias("path"), F.lit(0).cast("long").alias("pos"))
    changed = part.where("p_size > 10").select(of("p", "p_partkey").alias("path")).unionByName(supp.where("s_acctbal > 0").select(of("s", "s_suppkey").alias("path")))
    return detectors.identifier_fanout(detectors.Facts(symbols=symbols, uses=uses, changed=changed)).select("path", "class", "size", "evidence")


@query("""WITH need AS (SELECT DISTINCT p_brand, p_size % 3 AS name FROM part), ok AS (SELECT s_suppkey, s_acctbal > 4000 AS t FROM supplier WHERE s_nationkey > 1),
have AS (SELECT DISTINCT l_suppkey, p_brand, p_size % 3 AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
pairs AS (SELECT p_brand, l_suppkey FROM have JOIN need USING (p_brand, name) WHERE p_brand NOT IN ('Brand#1', 'Brand#2') GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM need n WHERE n.p_brand = have.p_brand))
SELECT 'b/' || p_brand || '.go' AS path, 1 AS class, count(*) AS size, p_brand || ': ' || sum(t::INT) || ' of ' || count(*) || ' implementors touched' AS evidence FROM pairs JOIN ok ON s_suppkey = l_suppkey GROUP BY p_brand HAVING count(*) >= 2 AND sum(t::INT) >= 0.5 * count(*)""")
def implementor_scan(spark, sf_dir):
    """The whole detector: brands are interfaces, two of them aliases or generic, suppliers are types, some aliases or generic."""
    part, li, supp = (table(spark, sf_dir, t) for t in ("part", "lineitem", "supplier"))
    file = lambda kind, key: F.concat(F.lit(kind), key, F.lit(".go")).alias("path")
    brand = F.col("p_brand")
    faces = part.select(F.concat(F.lit("b"), brand).alias("id"), F.lit("b").alias("pkg"), brand.alias("name"), F.lit("interface").alias("kind"), (brand == "Brand#1").alias("is_alias"), (brand == "Brand#2").alias("is_generic"), file("b/", brand)).distinct()
    solid = supp.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("s").alias("pkg"), F.col("s_name").alias("name"), F.lit("struct").alias("kind"), (F.col("s_nationkey") == 0).alias("is_alias"), (F.col("s_nationkey") == 1).alias("is_generic"), file("s", "s_suppkey"))
    name, sig = (F.col("p_size") % 3).cast("string").alias("name"), brand.alias("sig")
    methods = li.join(part, li.l_partkey == part.p_partkey).select(F.concat(F.lit("s"), "l_suppkey").alias("type_id"), name, sig, file("s", "l_suppkey"))
    need = part.select(F.concat(F.lit("b"), brand).alias("iface_id"), name, sig)
    changed = supp.where("s_acctbal > 4000").select(file("s", "s_suppkey"))
    facts = detectors.Facts(types=faces.unionByName(solid), methods=methods, iface_methods=need, changed=changed)
    return detectors.implementor_scan(facts).select("path", "class", "size", "evidence")


@query("""WITH e AS (SELECT p_brand FROM part WHERE p_brand NOT IN ('Brand#3', 'Brand#4') GROUP BY 1 HAVING count(*) >= 2), s AS (SELECT p_brand, s_acctbal > 0 AS t FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN e USING (p_brand))
SELECT 'e/' || p_brand || '.go' AS path, 1 AS class, count(*) AS size, p_brand || ': ' || sum(t::INT) || ' of ' || count(*) || ' switches touched' AS evidence FROM s GROUP BY p_brand HAVING count(*) >= 2 AND sum(t::INT) >= 0.5 * count(*)""")
def switch_case_symmetry(spark, sf_dir):
    """The whole detector: brands are enums, two of them aliases or generic, parts their constants, lines the switches in suppliers' files."""
    part, li, supp = (table(spark, sf_dir, t) for t in ("part", "lineitem", "supplier"))
    file = lambda kind, key: F.concat(F.lit(kind), key, F.lit(".go")).alias("path")
    brand = F.col("p_brand")
    types = part.select(brand.alias("id"), F.lit("e").alias("pkg"), brand.alias("name"), F.lit("named").alias("kind"), (brand == "Brand#3").alias("is_alias"), (brand == "Brand#4").alias("is_generic"), file("e/", brand)).distinct()
    consts = part.select(F.lit("e").alias("pkg"), F.col("p_partkey").cast("string").alias("name"), brand.alias("type_id"))
    sites = li.join(part, li.l_partkey == part.p_partkey).select(file("s", "l_suppkey"), F.col("l_orderkey").alias("pos"), brand.alias("type_id"))
    changed = supp.where("s_acctbal > 0").select(file("s", "s_suppkey"))
    return detectors.switch_case_symmetry(detectors.Facts(types=types, consts=consts, switch_sites=sites, changed=changed)).select("path", "class", "size", "evidence")


@query("SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n FROM events")
def time_bounds(spark, sf_dir):
    """The ends of a series' time axis."""
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rollup.time_bounds(table(spark, sf_dir, "events"), "ts").select(shown("first"), shown("last"), "n")


@query(f"WITH {_YEARS} SELECT o_custkey, round(s_head*1e6)/1e6 AS s_head FROM d WHERE s_head > 0 ORDER BY s_head DESC, o_custkey LIMIT 3")
def change_hotspots(spark, sf_dir):
    """The three most disordered units of a change, of those that are there afterwards."""
    return delta.hotspots(_year_deltas(spark, sf_dir), "o_custkey").select("o_custkey", micro(F.col("s_head")).alias("s_head"))


@query("""WITH e AS (SELECT p_brand, p_type FROM part GROUP BY 1, 2 HAVING count(*) >= 2),
g AS (SELECT p_partkey, part.p_brand, CASE WHEN p_size > 25 THEN 'bool' WHEN e.p_type IS NOT NULL THEN 'enum ' || e.p_type END AS state FROM part LEFT JOIN e ON e.p_brand = part.p_brand AND e.p_type = part.p_type),
u AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_linenumber <> 1 GROUP BY 1)
SELECT p_brand || '/' || p_partkey || '.go' AS path, 4 AS class, n AS size, 'f' || p_partkey || ' gains ' || state || ' for ' || n || ' external uses' AS evidence FROM g JOIN u ON l_partkey = p_partkey WHERE state IS NOT NULL AND n >= 2""")
def external_uses(spark, sf_dir):
    """The whole detector: parts are functions that gain a parameter, lines are uses, the first line of an order inside the package."""
    part, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    name, path = F.concat(F.lit("f"), "p_partkey"), F.concat_ws("/", "p_brand", F.concat(F.col("p_partkey"), F.lit(".go")))
    ident = F.concat_ws("#", "p_brand", name)
    base = part.select(path.alias("path"), F.lit("").alias("recv"), name.alias("name"), F.col("p_brand").alias("pkg"), F.lit(True).alias("exported"), F.split("p_name", " ").alias("params"))
    new = F.array(F.when(F.col("p_size") > 25, "bool").otherwise(F.col("p_type")))
    head = part.select(path.alias("path"), F.lit("").alias("recv"), name.alias("name"), F.col("p_brand").alias("pkg"), F.lit(True).alias("exported"), F.concat(F.split("p_name", " "), new).alias("params"))
    symbols = part.select(ident.alias("id"), F.col("p_brand").alias("pkg"), name.alias("name"), F.lit("func").alias("kind"), F.lit(True).alias("exported"), path.alias("path"))
    inside = F.when(F.col("l_linenumber") == 1, F.col("p_brand")).otherwise(F.concat(F.lit("s"), "l_suppkey"))
    uses = li.join(part, li.l_partkey == part.p_partkey).select(ident.alias("symbol_id"), inside.alias("pkg"), F.lit("").alias("path"), F.lit(0).cast("long").alias("pos"))
    kinds = part.select(F.concat_ws("#", "p_brand", "p_type").alias("id"), F.col("p_brand").alias("pkg"), F.col("p_type").alias("name"), F.lit("named").alias("kind"), F.lit(False).alias("is_alias"), F.lit(False).alias("is_generic"), F.lit("").alias("path")).distinct()
    consts = part.select(F.col("p_brand").alias("pkg"), name.alias("name"), F.concat_ws("#", "p_brand", "p_type").alias("type_id"))
    facts = detectors.Facts(symbols=symbols, uses=uses, types=kinds, consts=consts, base_funcs=base, head_funcs=head)
    return detectors.state_multiplier(facts).select("path", "class", "size", "evidence")


@query("""WITH RECURSIVE l AS (SELECT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
up AS (SELECT a, b FROM l UNION SELECT up.a, l.b FROM up JOIN l ON l.a = up.b),
m AS (SELECT 'r' || r_regionkey AS t, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation)
SELECT t AS type_id, name FROM m UNION SELECT a, name FROM up JOIN m ON m.t = up.b""")
def promoted_methods(spark, sf_dir):
    """Suppliers and customers embed nations, nations embed regions; their names are methods."""
    s, c, n, r = (table(spark, sf_dir, t) for t in ("supplier", "customer", "nation", "region"))
    ident = lambda kind, key: F.concat(F.lit(kind), key)
    embeds = s.select(ident("s", "s_suppkey").alias("type_id"), ident("n", "s_nationkey").alias("embedded_id"))
    embeds = embeds.unionByName(c.select(ident("c", "c_custkey").alias("type_id"), ident("n", "c_nationkey").alias("embedded_id")))
    embeds = embeds.unionByName(n.select(ident("n", "n_nationkey").alias("type_id"), ident("r", "n_regionkey").alias("embedded_id")))
    methods = r.select(ident("r", "r_regionkey").alias("type_id"), F.col("r_name").alias("name")).unionByName(n.select(ident("n", "n_nationkey").alias("type_id"), F.col("n_name").alias("name")))
    return detectors.promoted(methods.select("type_id", "name", F.lit("()").alias("sig"), F.lit("").alias("path")), embeds).select("type_id", "name")


@query("SELECT p_partkey, round(CASE WHEN p_size > 25 THEN -0.5 * log2(p_size / 25.0) ELSE 0.0 END * 1e6) / 1e6 AS bonus FROM part")
def downgrade_bonus(spark, sf_dir):
    """What lowering each size to 25 would earn."""
    return table(spark, sf_dir, "part").select("p_partkey", micro(delta.downgrade_bonus(F.col("p_size").cast("double"), F.lit(25.0))).alias("bonus"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) rn FROM orders), l AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_returnflag) a FROM lineitem GROUP BY 1),
x AS (SELECT o_custkey, o_orderkey, a, lead(a) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) b FROM o JOIN l ON o_orderkey = l_orderkey)
SELECT o_custkey, o_orderkey, b[len(b)] AS new FROM x WHERE len(b) = len(a) + 1 AND b[1:len(a)] = a""")
def state_multiplier(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"]).alias("a"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.withColumn("b", F.lead("a").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    return rows.select("o_custkey", "o_orderkey", detectors.added_last(F.col("a"), F.col("b")).alias("new")).where(F.col("new").isNotNull())


@query("""WITH h AS (SELECT 'p' || l_partkey AS path, CASE WHEN l_quantity > 40 THEN 2 ELSE 1 END AS class FROM lineitem UNION ALL SELECT 'p' || l_suppkey, 4 FROM lineitem), c AS (SELECT DISTINCT 'p' || 2 * p_partkey AS path FROM part)
SELECT coalesce(x.path, c.path) AS path, coalesce(x.class, 0) AS class, coalesce(n, 0) AS n_hits FROM (SELECT path, max(class) class, count(*) n FROM h GROUP BY 1) x FULL JOIN c ON x.path = c.path""")
def scaling_rollup(spark, sf_dir):
    """Two detectors' hits, on parts and suppliers, over changed paths, some without a hit and some hits beside them."""
    li = table(spark, sf_dir, "lineitem")
    path = lambda c: F.concat(F.lit("p"), c.cast("string")).alias("path")
    hit = lambda name, rank, key: li.select(F.lit(name).alias("detector"), rank.alias("class"), F.lit(1).cast("long").alias("size"), path(F.col(key)), F.lit("").alias("evidence"))
    hits = hit("parts", F.when(F.col("l_quantity") > 40, 2).otherwise(1), "l_partkey").unionByName(hit("suppliers", F.lit(4), "l_suppkey"))
    changed = table(spark, sf_dir, "part").select(path(2 * F.col("p_partkey"))).distinct()
    return detectors.breakdown(hits, changed).select("path", "class", F.size("hits").cast("long").alias("n_hits"))


# ---------------------------------------------------------------- predicates


_GO = f"CASE page_id % 4 WHEN 0 THEN 'vendor/' WHEN 1 THEN '.x/' ELSE '' END || {_URL} || CASE page_id % 3 WHEN 0 THEN '.txt' ELSE '.go' END"


@query(f"SELECT page_id, path, ends_with(path, '.go') AND len(list_filter(string_split(path, '/')[1:-2], lambda d: d = 'vendor' OR starts_with(d, '.'))) = 0 AS ok FROM (SELECT page_id, {_GO} AS path FROM pages)")
def analyzable_path(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(_GO).alias("path"))
    return rows.select("page_id", "path", paths.analyzable(F.col("path")).alias("ok"))


@query("""WITH s AS (SELECT conv_id, max((role='user')::INT) a, max((role='assistant' AND turn > 2)::INT) b FROM conversations GROUP BY 1)
SELECT c.conv_id, c.turn FROM conversations c ANTI JOIN (SELECT conv_id FROM s WHERE a <> b) x USING (conv_id)""")
def parse_asymmetry(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    sides = c.groupBy("conv_id").agg(F.max((F.col("role") == "user").cast("int")).alias("a"), F.max(((F.col("role") == "assistant") & (F.col("turn") > 2)).cast("int")).alias("b"))
    return c.join(sides.where("a <> b"), "conv_id", "left_anti").select("conv_id", "turn")
