"""The named queries and the SQL that states the same result independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as t
from ..functions import vectors as v
from ..operators import bench, evaluate, extract, labeling, layout, quality, synth
from ..sources import readers
from . import base
from .base import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Fields from printed text


_SEEN = [base.NAMED if f == "store_brand" else f for f in fixed.FIELDS]


@query(base.SQL + f"SELECT k, {', '.join(_SEEN)} FROM f")
def q_extract_fields(spark, sf_dir):
    """The whole extraction, of receipts that were read badly: normal forms, repairs, likest brands, stripping, capitals."""
    return extract.extract_fields(base.misread(base.rendered(spark, sf_dir)), "text", base.SHOPS).select("k", *fixed.FIELDS)


def _one_field(field: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return extract.with_fields(base.rendered(spark, sf_dir), "text", fixed.BRANDS + base.SHOPS).select("k", field)

    QUERIES[f"q_extract_{field}"] = run
    ORACLES[f"q_extract_{field}"] = base.SQL + f"SELECT k, {field} FROM f"


for _f in fixed.FIELDS:
    _one_field(_f)


@query(base.SQL + "SELECT k, store_brand AS brand FROM f")
def q_brand_join(spark, sf_dir):
    """Brands as a table: its few rows (checked) go to every task as one, and a text's is the first that it holds."""
    brands = spark.createDataFrame(list(enumerate(fixed.BRANDS + base.SHOPS)), "ord int, brand string")
    if brands.count() > labeling.MOST_PROTOTYPES:
        raise ValueError(f"more than {labeling.MOST_PROTOTYPES} brands")
    one = brands.agg(F.array_sort(F.collect_list(F.struct("ord", t.loose(F.col("brand")).alias("form"), "brand"))).alias("all"))
    d = base.rendered(spark, sf_dir).select("k", t.loose(F.col("text")).alias("whole")).crossJoin(F.broadcast(one))
    return d.select("k", F.get(F.filter("all", lambda b: F.contains(F.col("whole"), b["form"])), F.lit(0))["brand"].alias("brand"))


@query(base.SQL + "SELECT k, total, deposit FROM r")
def q_cross_line_money(spark, sf_dir):
    """Labels and amounts on lines of their own."""
    d = base.amounts(spark, sf_dir).select("k", F.concat(F.lit("合計\n"), t.yen(F.col("total")), F.lit("\n現金 \n "), F.col("deposit")).alias("text"))
    return d.select("k", extract.money_of(F.col("text"), "total").alias("total"), extract.money_of(F.col("text"), "deposit").alias("deposit"))


@query(base.SQL + "SELECT k, total FROM r WHERE total > 0")
def q_total_derived(spark, sf_dir):
    d = base.amounts(spark, sf_dir).select("k", F.concat(F.lit("お預り "), t.yen(F.col("deposit")), F.lit("\nおつり "), t.yen(F.col("change"))).alias("text"))
    return extract.with_fields(d, "text", fixed.BRANDS).select("k", "total").where("total IS NOT NULL")


@query(base.SQL + "SELECT k, (CASE WHEN a8 > 0 THEN t8 ELSE 0 END + CASE WHEN a10 > 0 THEN t10 ELSE 0 END)::BIGINT AS tax, ((a8 > 0)::INT + (a10 > 0)::INT)::INT AS n FROM r")
def q_extract_tax_by_rate(spark, sf_dir):
    """Rates before and after the label, written in two ways; a rate's second amount doesn't count."""
    line = lambda r, form: F.when(F.col(f"a{r}") > 0, F.concat(form(r), t.yen(F.col(f"t{r}"))))
    before, after = (lambda r: F.lit(f"{r}%対象内消費税 ")), (lambda r: F.lit(f"消費税等({r}.0%) "))
    again = F.when(F.col("a8") > 0, F.lit("内税 8% ¥7"))
    text = F.concat_ws("\n", line(8, before), line(10, after), again)
    d = base.amounts(spark, sf_dir).select("k", extract.tax_matches(text).alias("m"))
    rates = F.size(F.array_distinct(F.transform("m", lambda x: x["rate"])))
    return d.select("k", extract.tax_sum(F.col("m")).alias("tax"), rates.alias("n"))


@query(base.SQL + "SELECT k, t8 + t10 AS tax FROM r")
def q_extract_tax_norate(spark, sf_dir):
    text = F.concat(F.lit("内税10%対象額 ¥1,000\n消費税等(8%) ¥3\n(内税) "), t.yen(F.col("t8") + F.col("t10")))
    return base.amounts(spark, sf_dir).select("k", extract.tax_of(text).alias("tax"))


@query(base.SQL + "SELECT i.k, line, yen, (CASE WHEN (i.k + line) % 3 = 0 THEN yen ELSE line END)::BIGINT AS amount FROM i")
def q_line_amount(spark, sf_dir):
    line = F.when((F.col("k") + F.col("line")) % 3 == 0, F.concat(F.lit("品 "), t.yen(F.col("yen")), F.lit(" 2点"))).otherwise(F.concat(t.yen(F.col("yen"), comma=False).substr(2, 20), F.lit("円 "), F.col("line")))
    return base.items(spark, sf_dir).select("k", "line", "yen", extract.line_amount(line).alias("amount"))


@query(
    "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 30 < 24 THEN lpad((o_orderkey % 30)::VARCHAR, 2, '0') || ':05' END AS time FROM orders"
)
def q_line_datetime(spark, sf_dir):
    """A line's date, and its time with the hour checked."""
    line = F.concat(F.date_format("o_orderdate", "yyyy/M/d"), F.lit(" "), (F.col("o_orderkey") % 30).cast("string"), F.lit(":05"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), extract.line_date(line).alias("date"), extract.line_time(line).alias("time"))


@query("SELECT c_custkey, replace(n_name, '_', '') || '店' AS branch FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q_line_branch(spark, sf_dir):
    d = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return d.select("c_custkey", extract.line_branch(F.concat(F.lit("¥ "), F.replace(F.col("n_name"), F.lit("_"), F.lit(" ")), F.lit(" 店"))).alias("branch"))


@query(base.SQL + "SELECT k, total FROM r")
def q_legacy_total(spark, sf_dir):
    return base.amounts(spark, sf_dir).select("k", extract.legacy_fields(F.concat(F.lit("合 計 "), t.yen(F.col("total"))))["amounts"]["total"].alias("total"))


@query(base.SQL + "SELECT k, date, total FROM f")
def q_extract_normalised(spark, sf_dir):
    """Full-width digits and signs, read after NFKC."""
    narrow, wide = "0123456789¥,/:()", "０１２３４５６７８９￥，／：（）"
    d = base.rendered(spark, sf_dir).withColumn("text", F.translate("text", narrow, wide))
    return extract.extract_fields(d, fuzzy=False).select("k", "date", "total")


# Text functions


@query("SELECT doc_id, regexp_replace(text, '[0-9]', '0', 'g') AS masked FROM documents")
def q_digit_mask(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.digit_mask(F.col("text")).alias("masked"))


@query("SELECT p_partkey, '合計 額領対費減軽 ' || p_name AS repaired FROM part")
def q_glyph_translate(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", t.repaired(F.concat(F.lit("合十 额领对费减轻 "), F.col("p_name"))).alias("repaired"))


@query("SELECT page_id, regexp_replace(url, '[\\s.-]', '', 'g') AS compact, 'バビブ' || regexp_replace(url, '[\\s.-]', '', 'g') AS loose FROM pages")
def q_compact_loose(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.compact(F.col("url")).alias("compact"), t.loose(F.concat(F.lit("パ・ピープ"), F.col("url"))).alias("loose"))


@query(
    "SELECT DISTINCT line FROM (SELECT unnest(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x{1c}\\x{1d}\\x{1e}\\x{85}\\x{2028}\\x{2029}]')) AS line FROM documents) "
    "WHERE regexp_matches(line, '[^\\x09-\\x0D\\x{1c}-\\x{1f} \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]')"
)
def q_distinct_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(t.lines(F.col("text"))).alias("line")).distinct()


@query("SELECT o_orderkey, '¥' || format('{:,}', floor(o_totalprice)::BIGINT) AS yen, array_to_string(string_split(o_orderstatus || o_orderpriority, ''), ' ') AS spaced FROM orders")
def q_yen_format(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", t.yen(F.floor("o_totalprice").cast("bigint")).alias("yen"), t.letter_spaced(F.concat("o_orderstatus", "o_orderpriority")).alias("spaced"))


@query("SELECT page_id, string_split(url, '/')[-1] AS base, regexp_replace(string_split(url, '/')[-1], '(.)\\.[^.]*$', '\\1') AS stem FROM pages")
def q_path_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.base_name(F.col("url")).alias("base"), t.stem(F.col("url")).alias("stem"))


@query()
def q_nfkc(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.nfkc("text").alias("text"))


@query("SELECT p_partkey, 'ガ ' || p_partkey || '¥' || p_name AS text FROM part")
def q_nfkc_width(spark, sf_dir):
    """Wide digits, half-width kana and signs, beside what stays."""
    wide = F.concat(F.lit("ｶﾞ　"), F.translate(F.col("p_partkey").cast("string"), "0123456789", "０１２３４５６７８９"), F.lit("￥"), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", t.normalised(wide).alias("text"))


@query(base.SQL + "SELECT k, store_brand AS brand FROM f")
def q_brand_fuzzy(spark, sf_dir):
    """A letter of the shop's name misread: brands by similarity, in whole texts."""
    d = base.rendered(spark, sf_dir).select("k", F.regexp_replace("text", "^(.).", "$1◇").alias("text"))
    return d.select("k", extract.brand_fuzzy(fixed.BRANDS + base.SHOPS)("text").alias("brand"))


@query("SELECT c_custkey, 'カード' || c_custkey || '-x サービス' AS mark, CASE WHEN c_custkey % 8 = 1 THEN '12%' WHEN c_custkey % 8 = 3 THEN '38%' WHEN c_custkey % 8 = 5 THEN '62%' WHEN c_custkey % 8 = 7 THEN '88%' ELSE (c_custkey % 8 * 12.5)::BIGINT || '%' END AS share FROM customer")
def q_marks_and_shares(spark, sf_dir):
    """Hyphens between katakana, and shares as whole per cents, halves to even."""
    c = F.col("c_custkey")
    mark = t.long_mark(F.concat(F.lit("カ-ド"), c.cast("string"), F.lit("-x サ-ビス")))
    return table(spark, sf_dir, "customer").select("c_custkey", mark.alias("mark"), t.percent(c % 8 / 8).alias("share"))


# Layout


@query(base.SQL + "SELECT k, string_agg('L' || line || ' ¥' || yen, chr(10) ORDER BY line) AS text FROM i GROUP BY k")
def q_lines_from_boxes(spark, sf_dir):
    """Two boxes a line, with uneven tops, out of order."""
    box = lambda left, shift, text: F.struct((F.col("line") * 30 + shift).cast("double").alias("top"), (F.col("line") * 30 + shift + 20).cast("double").alias("bottom"), F.lit(left).alias("left"), text.alias("text"))
    d = base.items(spark, sf_dir).select("k", F.explode(F.array(box(200.0, 3, t.yen(F.col("yen"), comma=False)), box(10.0, 0, F.concat(F.lit("L"), F.col("line"))))).alias("b"))
    d = d.groupBy("k").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("b").alias("h"), "b"))).alias("all"))
    return d.select("k", layout.to_text(F.transform("all", lambda x: x["b"])).alias("text"))


@query(
    "WITH s AS (SELECT l_orderkey AS order_, l_linenumber AS line, l_returnflag AS l, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS c FROM lineitem), "
    "p AS (SELECT *, row_number() OVER w AS pos, lag(c, 1, 0) OVER w AS prior FROM s WINDOW w AS (PARTITION BY order_ ORDER BY line, c)) "
    "SELECT order_, string_agg(l, '' ORDER BY pos) AS text FROM p WHERE c <> 0 AND c <> prior GROUP BY order_"
)
def q_ctc_collapse(spark, sf_dir):
    """Return flags as steps: N is blank."""
    step = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber"), step.alias("s")))).alias("all"))
    d = d.select("order_", layout.ctc_text(F.transform("all", lambda x: x["s"]), F.array(F.lit("blank"), F.lit("A"), F.lit("R"))).alias("text"))
    return d.where("text <> ''")


@query(base.SQL + "SELECT k, (72 + 26 + 10 + count(*) * 31 + max(line) * 29)::BIGINT AS height FROM i GROUP BY k")
def q_receipt_height(spark, sf_dir):
    row = lambda kind, size, px: F.struct(F.lit(kind).alias("kind"), F.lit(size).alias("size"), F.lit(px).alias("px"))
    d = base.items(spark, sf_dir).groupBy("k").agg(F.count("*").cast("int").alias("n"), F.max("line").alias("m"))
    rows = F.concat(F.array(row("dash", 0, 0), row("gap", 0, 10)), F.array_repeat(row("lr", 22, 0), F.col("n")), F.array_repeat(row("c", 20, 0), F.col("m")))
    return d.select("k", layout.receipt_height(rows).alias("height"))


# Labels by embeddings: the first vector of each label is its prototype

_VECTORS = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS emb FROM embeddings),
p AS (SELECT label AS proto_idx, 'L' || label AS label, arg_min(emb, vec_id) AS emb FROM e GROUP BY label),
s AS (SELECT vec_id, proto_idx, p.label, list_cosine_similarity(e.emb, p.emb) AS score FROM e, p),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, proto_idx) = 1)
"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("emb"))
    protos = e.groupBy("label").agg(F.min_by("emb", "vec_id").alias("emb")).select(F.col("label").alias("proto_idx"), F.concat(F.lit("L"), "label").alias("label"), "emb")
    return e, protos


@query(_VECTORS + "SELECT vec_id, CASE WHEN score < 0.3 THEN 'other' ELSE label END AS label, round(score, 6) AS score FROM b")
def q_line_label(spark, sf_dir):
    e, protos = _vectors(spark, sf_dir)
    d = labeling.nearest(e, protos, "vec_id")
    return d.select("vec_id", labeling.at_threshold(F.col("label"), F.col("score"), 0.3).alias("label"), F.round("score", 6).alias("score"))


@query(_VECTORS + "SELECT threshold, count(*) FILTER (score >= threshold) AS labelled, count(*) FILTER (score < threshold) AS other FROM b, (SELECT unnest([0.7, 0.75, 0.8, 0.85, 0.9]::DOUBLE[]) AS threshold) GROUP BY threshold")
def q_threshold_sweep(spark, sf_dir):
    """One pass: counts for every threshold side by side, then a row each."""
    e, protos = _vectors(spark, sf_dir)
    d = labeling.nearest(e, protos, "vec_id")
    each = F.explode(F.array(*map(F.lit, fixed.SWEEP))).alias("threshold")
    return d.select("score", each).groupBy("threshold").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("labelled"), F.count_if(F.col("score") < F.col("threshold")).alias("other"))


@query(_VECTORS + "SELECT * FROM (SELECT dims, vec_id, p.label, round(list_cosine_similarity(e.emb[:dims], p.emb[:dims]), 6) AS score FROM e, p, (SELECT unnest([32, 16, 8]) AS dims) QUALIFY row_number() OVER (PARTITION BY dims, vec_id ORDER BY list_cosine_similarity(e.emb[:dims], p.emb[:dims]) DESC, proto_idx) = 1)")
def q_prefix_dims(spark, sf_dir):
    e, protos = _vectors(spark, sf_dir)
    return labeling.nearest_by_dims(e, protos, [32, 16, 8], "vec_id").select("dims", "vec_id", "label", F.round("score", 6).alias("score"))


@query(_VECTORS + ", h AS (SELECT vec_id, label FROM (SELECT vec_id, proto_idx, p.label, list_cosine_similarity(e.emb[:32], p.emb[:32]) AS score FROM e, p) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, proto_idx) = 1) SELECT count(*) AS n, count(*) FILTER (b.label = h.label) AS agree, count(*) FILTER (b.label = h.label) / count(*) AS rate FROM b JOIN h USING (vec_id)")
def q_label_agreement(spark, sf_dir):
    e, protos = _vectors(spark, sf_dir)
    d = labeling.nearest_by_dims(e, protos, [64, 32], "vec_id").groupBy("vec_id").agg(F.max(F.when(F.col("dims") == 64, F.col("label"))).alias("label"), F.max(F.when(F.col("dims") == 32, F.col("label"))).alias("other"))
    agree = F.count_if(F.col("label") == F.col("other"))
    return d.agg(F.count("*").alias("n"), agree.alias("agree"), (agree / F.count("*")).alias("rate"))


@query(_VECTORS + "SELECT a.proto_idx AS i, b.proto_idx AS j, round(list_cosine_similarity(a.emb, b.emb), 6) AS score FROM p AS a JOIN p AS b ON a.proto_idx < b.proto_idx")
def q_pairwise_cosine(spark, sf_dir):
    """The prototypes' similarity table."""
    _, p = _vectors(spark, sf_dir)
    a, b = p.select(F.col("proto_idx").alias("i"), F.col("emb").alias("x")), p.select(F.col("proto_idx").alias("j"), F.col("emb").alias("y"))
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", F.round(v.cosine(F.col("x"), F.col("y")), 6).alias("score"))


_INT8 = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
s AS (SELECT *, greatest(list_max(list_transform(x, lambda a: abs(a))) / 127.0::DOUBLE, 1e-8::DOUBLE) AS scale FROM e),
q AS (SELECT *, list_transform(x, lambda a: greatest(-128, least(127, round_even(a / scale, 0)))::INT) AS code FROM s),
c AS (SELECT *, list_cosine_similarity(x, list_transform(code, lambda a: a * scale)) AS score FROM q)
"""


@query(_INT8 + "SELECT vec_id, round(scale, 9) AS scale, array_to_string(code, ',') AS code, round(score, 6) AS score FROM c")
def q_int8_roundtrip(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    d = e.withColumn("scale", v.int8_scale(F.col("x"))).withColumn("code", v.int8(F.col("x"), F.col("scale")))
    score = v.cosine(F.col("x"), v.from_int8(F.col("code"), F.col("scale")))
    return d.select("vec_id", F.round("scale", 9).alias("scale"), F.concat_ws(",", F.col("code").cast("array<string>")).alias("code"), F.round(score, 6).alias("score"))


@query(_INT8 + "SELECT round(avg(score), 6) AS mean, round(min(score), 6) AS least FROM c")
def q_int8_error(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("x"))
    d = e.withColumn("scale", v.int8_scale(F.col("x")))
    d = d.select(v.cosine(F.col("x"), v.from_int8(v.int8(F.col("x"), F.col("scale")), F.col("scale"))).alias("score"))
    return d.agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.min("score"), 6).alias("least"))


@query("SELECT vec_id, round(list_aggregate(list_transform(m, lambda a: a * a), 'sum'), 6) AS square, round(m[1] / sqrt(list_aggregate(list_transform(m, lambda a: a * a), 'sum')), 6) AS first FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 1.5) AS m FROM embeddings)")
def q_mean_pool(spark, sf_dir):
    """Three rows, of which the mask leaves two: the vector and its double."""
    x = F.col("embedding").cast("array<double>")
    pooled = v.mean_pool(F.array(x, F.transform(x, lambda a: a * 2), F.transform(x, lambda a: -a)), F.array(F.lit(1), F.lit(1), F.lit(0)))
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(x, lambda a: a * 1.5).alias("m"), pooled.alias("u"))
    return d.select("vec_id", F.round(v.dot(F.col("m"), F.col("m")), 6).alias("square"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


# Fallback


@query(base.SQL + "SELECT k, total, CASE WHEN k % 2 = 0 THEN deposit END AS deposit, CASE WHEN k % 2 = 1 THEN change END AS change, CASE WHEN k % 2 = 1 THEN 'regex' ELSE 'regex+fallback' END AS source, (CASE WHEN k % 2 = 0 THEN 6 ELSE 6 END)::INT AS n_missing FROM r")
def q_fallback_merge(spark, sf_dir):
    """Every other receipt lacks total and deposit, which labels give; a change found stays."""
    k, null = F.col("k"), F.lit(None)
    base_ = base.amounts(spark, sf_dir)
    kinds = {f: "bigint" if f in (*extract.MONEY_FIELDS, "tax") else "string" for f in fixed.FALLBACK_FIELDS}
    found = base_.select(k.alias("image_id"), *({"total": F.when(k % 2 == 1, F.col("total")), "change": F.when(k % 2 == 1, F.col("change"))}.get(f, null.cast(kinds[f])).alias(f) for f in fixed.FALLBACK_FIELDS))
    other = base_.where(k % 2 == 0).select(k.alias("image_id"), *({"total": F.col("total"), "deposit": F.col("deposit")}.get(f, null.cast(kinds[f])).alias(f) for f in fixed.FALLBACK_FIELDS))
    d = labeling.fill_missing(found, other)
    return d.select(F.col("image_id").alias("k"), "total", "deposit", "change", "source", F.size("missing").alias("n_missing"))


@query(base.SQL + "SELECT k, (CASE k % 4 WHEN 0 THEN 'deposit' WHEN 1 THEN 'other' WHEN 2 THEN 'change' ELSE 'other' END) AS label FROM r")
def q_guarded_labels(spark, sf_dir):
    k = F.col("k")
    line = F.when(k % 4 == 0, "お預り ¥100").when(k % 4 == 1, "商品 ¥100").when(k % 4 == 2, "おつり ¥0").otherwise("おにぎり 322")
    return base.amounts(spark, sf_dir).select("k", labeling.guarded(F.when(k % 4 < 2, "deposit").otherwise("change"), line).alias("label"))


@query(base.SQL + "SELECT k, total, CASE WHEN k % 3 <> 0 THEN deposit END AS deposit, t8 + t10 AS tax, '2026-06-01' AS date, lpad((k % 24)::VARCHAR, 2, '0') || ':30' AS time FROM r")
def q_fields_from_labels(spark, sf_dir):
    """Labelled lines, of which the best has no value or is of a lower score."""
    k = F.col("k")
    line = lambda text, label, score: F.struct(text.alias("line"), F.lit(label).alias("label"), F.lit(score).alias("score"))
    rows = F.array(
        line(F.lit("合計"), "total", 0.99), line(F.concat(F.lit("合計 "), t.yen(F.col("total"))), "total", 0.9), line(F.lit("合計 ¥5"), "total", 0.8),
        line(F.concat(F.lit("お預り "), t.yen(F.col("deposit"))), "deposit", 0.9), line(F.lit("¥999,999"), "tax", 0.99),
        line(F.concat(F.lit("内消費税 "), t.yen(F.col("t8") + F.col("t10"))), "tax", 0.9), line(F.lit("26.06.01"), "datetime", 0.9), line(F.concat(k % 24, F.lit("時30分")), "datetime", 0.85),
    )
    d = base.amounts(spark, sf_dir).select(k.alias("image_id"), F.inline(rows)).where((F.col("label") != "deposit") | (F.col("image_id") % 3 != 0))
    out = labeling.fields_from_labels(d)
    return out.select(F.col("image_id").alias("k"), "total", "deposit", "tax", "date", "time")


@query("SELECT o_orderkey, array_to_string(list_filter(['a', 'b', 'c'], lambda x: x <> CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'z' END), ',') AS missing FROM orders")
def q_missing_fields(spark, sf_dir):
    have = F.array(F.when(F.col("o_orderkey") % 3 == 0, "a").when(F.col("o_orderkey") % 3 == 1, "b").otherwise("z"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(",", F.array_except(F.array(*map(F.lit, "abc")), have)).alias("missing"))


# Scores: predictions are the truth with some fields lost and some wrong

_CONDITIONS = ["clean", "light", "medium", "heavy"]
_FACTS = base.SQL + """, g AS (SELECT k, 's' || k % 3 AS suite, (['clean', 'light', 'medium', 'heavy'])[k % 4 + 1] AS cond, unnest(['total', 'tax', 'deposit', 'change', 'store_branch']) AS field,
  unnest([total::VARCHAR, tax::VARCHAR, deposit::VARCHAR, change::VARCHAR, store_branch]) AS expected FROM f),
x AS (SELECT *, CASE WHEN field = 'total' AND k % 7 = 0 THEN 0 WHEN field = 'tax' AND k % 11 = 0 THEN 0 WHEN field = 'change' AND k % 5 = 0 THEN 0 ELSE 1 END AS good FROM g WHERE expected IS NOT NULL)
"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and predictions side by side, so that texts are read once."""
    k = F.col("k")
    fields = ["total", "tax", "deposit", "change", "store_branch"]
    truth = extract.with_fields(base.rendered(spark, sf_dir), "text", fixed.BRANDS + base.SHOPS)
    wrong = {"total": F.when(k % 7 != 0, F.col("total")), "tax": F.when(k % 11 == 0, F.col("tax") + 1).otherwise(F.col("tax")), "change": F.when(k % 5 != 0, F.col("change")), "store_branch": F.concat(F.lit("X"), "store_branch")}
    both = truth.select("k", F.struct(*fields).alias("want"), F.struct(*(wrong.get(f, F.col(f)).alias(f) for f in fields)).alias("have"))
    rows = evaluate.facts_in_row(both, ["k"], "want", "have", fields)
    return rows.withColumns({"suite": F.concat(F.lit("s"), k % 3), "cond": F.element_at(F.array(*map(F.lit, _CONDITIONS)), (k % 4 + 1).cast("int"))})


@query(_FACTS + "SELECT k, sum(good)::BIGINT AS n_ok, count(*) AS n FROM x GROUP BY k")
def q_score_by_image(spark, sf_dir):
    return evaluate.score_by(_scored(spark, sf_dir), "k")


@query(_FACTS + "SELECT field, sum(good)::BIGINT AS n_ok, count(*) AS n FROM x GROUP BY field")
def q_score_by_field(spark, sf_dir):
    return evaluate.score_by(_scored(spark, sf_dir), "field")


@query(_FACTS + "SELECT field, " + ", ".join(f"count(*) FILTER (good = 1 AND cond = '{c}') AS {c}" for c in _CONDITIONS) + " FROM x GROUP BY field")
def q_score_pivot(spark, sf_dir):
    return evaluate.score_pivot(_scored(spark, sf_dir), "field", "cond", _CONDITIONS)


@query(_FACTS + "SELECT CASE WHEN grouping(suite) = 1 THEN 'TOTAL' ELSE suite END AS suite, sum(good)::BIGINT AS n_ok, count(*) AS n FROM x GROUP BY ROLLUP (suite)")
def q_score_rollup(spark, sf_dir):
    return evaluate.score_rollup(_scored(spark, sf_dir), "suite")


@query(_FACTS + "SELECT cond, sum(good)::BIGINT AS n_ok, 33::BIGINT AS n FROM x GROUP BY cond")
def q_condition_totals(spark, sf_dir):
    return evaluate.condition_totals(_scored(spark, sf_dir), 33)


@query(_FACTS + "SELECT suite, min(k) AS first FROM x GROUP BY suite")
def q_suite_order(spark, sf_dir):
    return evaluate.first_seen(_scored(spark, sf_dir), "suite", "k")


@query(_FACTS + "SELECT field, count(*) AS n, sum(good)::BIGINT AS n_ok, CASE field WHEN 'store_branch' THEN 1 WHEN 'total' THEN 5 WHEN 'tax' THEN 6 WHEN 'deposit' THEN 7 ELSE 8 END::INT AS ordinal FROM x GROUP BY field")
def q_field_order(spark, sf_dir):
    return evaluate.in_field_order(evaluate.score_by(_scored(spark, sf_dir), "field"))


@query(_FACTS + ", y AS (SELECT k, expected, CASE WHEN field = 'tax' THEN 'tax: ' || expected || ' -> ' || (expected::BIGINT + 1) ELSE field || ': ' || expected || ' -> -' END AS line FROM x WHERE good = 0) SELECT k, string_agg(line, '; ' ORDER BY line) AS wrong FROM y GROUP BY k")
def q_wrong_fields(spark, sf_dir):
    return evaluate.wrong_fields(_scored(spark, sf_dir), "k")


@query(_FACTS + ", n AS (SELECT field, count(DISTINCT k) AS n FROM x GROUP BY field) SELECT n.field, n, " + ", ".join(f"count(*) FILTER (good = 1 AND cond = '{c}') AS {c}" for c in _CONDITIONS) + " FROM n JOIN x ON n.field = x.field GROUP BY ALL")
def q_field_by_condition(spark, sf_dir):
    return evaluate.field_by_condition(_scored(spark, sf_dir), _CONDITIONS, "k")


@query("SELECT s_suppkey AS case_id, cond, CASE cond WHEN 'clean' THEN 'c' || s_suppkey || '.png' ELSE 'c' || s_suppkey || '_' || cond || '.jpg' END AS image FROM supplier, (SELECT unnest(['clean', 'light', 'medium', 'heavy']) AS cond)")
def q_by_condition(spark, sf_dir):
    """Clean and degraded images of each case; degraded ones of unknown cases don't count."""
    cases = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("case_id"), F.concat(F.lit("c"), F.col("s_suppkey"), F.lit(".png")).alias("image"))
    more = cases.unionByName(spark.createDataFrame([(-1, "none.png")], "case_id long, image string"))
    return evaluate.by_condition(cases, synth.degradations(more.select("image"), more))


@query(base.SQL + "SELECT k, 2::INT AS ocr_lines, 3::INT AS fields_count, 1::INT AS fallback_added FROM r")
def q_stage_counts(spark, sf_dir):
    d = base.amounts(spark, sf_dir).select("k", "total", "deposit", "change", F.lit("合計\n \n現金").alias("text"), F.array(F.lit("change")).alias("added"))
    absent = {f: F.lit(None).cast("string") for f in fixed.FIELDS if f not in extract.MONEY_FIELDS}
    return evaluate.stage_counts(d.withColumns(absent), "k", added="added")


@query("SELECT o_orderkey AS k, o_orderkey % 3 <> 1 AS narrow, o_orderkey % 2 = 0 AS wide FROM orders")
def q_two_sided_branch(spark, sf_dir):
    """A branch may be longer in front; the labeller's may be shorter too."""
    k = F.col("o_orderkey")
    got = F.when(k % 3 == 0, "本店").when(k % 3 == 1, "別館").otherwise("駅前本店")
    lenient = evaluate.is_lenient_match(F.lit("store_branch"), F.when(k % 2 == 0, "本店").otherwise("別店"), F.lit("駅前本店"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), evaluate.is_match(F.lit("store_branch"), got, F.lit("本店")).alias("narrow"), lenient.alias("wide"))


@query("SELECT event_id, 'tl,tr,br,bl' AS corners, round(least(10 + event_id % 7, (4 + event_id % 3)::DOUBLE), 6) AS side, event_id % 10 >= 5 AND event_id % 3 > 0 AS fine FROM events")
def q_boxes(spark, sf_dir):
    """Corners in any order; boxes too small or unsure."""
    e = F.col("event_id")
    width, height = (10 + e % 7).cast("double"), (4 + e % 3).cast("double")
    at = {"tl": (F.lit(5.0), F.lit(3.0)), "tr": (width + 5, F.lit(3.0)), "br": (width + 5, height + 3), "bl": (F.lit(5.0), height + 3)}
    points = F.array(*(F.struct(at[n][0].alias("x"), at[n][1].alias("y")) for n in ("br", "tl", "bl", "tr")))
    d = table(spark, sf_dir, "events").select("event_id", layout.corners(points).alias("c"), width.alias("w"), height.alias("h"))
    name = lambda p: F.when((p["x"] == 5) & (p["y"] == 3), "tl").when(p["x"] == 5, "bl").when(p["y"] == 3, "tr").otherwise("br")
    unclipped = F.transform("c", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return d.select("event_id", F.array_join(F.transform("c", name), ",").alias("corners"), F.round(layout.short_side(F.col("c")), 6).alias("side"), layout.valid(F.col("c"), (F.col("event_id") % 10) / 11, unclipped).alias("fine"))


@query("SELECT p_type AS model, 'v' || (p_size % 2) AS variant, size, size / sum(size) OVER () AS share FROM (SELECT p_type, p_size, sum(p_partkey)::BIGINT AS size FROM (SELECT p_type, p_size % 2 AS p_size, p_partkey FROM part) GROUP BY ALL) WHERE p_size = length(p_type) % 2")
def q_selected_models(spark, sf_dir):
    models = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("model"), F.concat(F.lit("v"), F.col("p_size") % 2).alias("variant")).agg(F.sum("p_partkey").alias("size"))
    choice = models.select("model").distinct().withColumn("variant", F.concat(F.lit("v"), F.length("model") % 2))
    return bench.selected(models, choice)


@query("SELECT s_name AS part, CASE WHEN s_suppkey % 4 = 0 THEN 'other-' || s_suppkey ELSE 'own-' || s_suppkey END AS path FROM supplier")
def q_swapped_models(spark, sf_dir):
    d = table(spark, sf_dir, "supplier")
    config = d.select(F.col("s_name").alias("part"), F.concat(F.lit("own-"), "s_suppkey").alias("path"))
    return bench.swapped(config, d.where("s_suppkey % 4 = 0").select(F.col("s_name").alias("part"), F.concat(F.lit("other-"), "s_suppkey").alias("path")))


@query("SELECT p_partkey FROM part ORDER BY md5('7:' || p_partkey), p_partkey LIMIT 47")
def q_sampled_rows(spark, sf_dir):
    """Calibration rows: a seeded sample without replacement."""
    return bench.sampled(table(spark, sf_dir, "part").select("p_partkey"), 47, 7, "p_partkey")


_ABC = """
WITH x AS (SELECT 's' || o_orderkey % 3 AS suite, o_orderkey AS k, o_orderkey % 5 <> 0 AS current_ok, o_orderkey % 10 = 0 AS current_null, o_orderkey % 7 <> 0 AS labeler_ok, o_orderkey % 14 = 0 AS labeler_null FROM orders)
SELECT suite, count(*) FILTER (current_ok) AS c_ok, count(*) FILTER (current_ok AND NOT labeler_ok AND labeler_null) AS broken_missing, count(*) FILTER (current_ok AND NOT labeler_ok AND NOT labeler_null) AS broken_wrong,
  count(*) FILTER (NOT current_ok) AS ng, count(*) FILTER (NOT current_ok AND current_null) AS ng_missing, count(*) FILTER (NOT current_ok AND NOT current_null) AS ng_wrong,
  count(*) FILTER (NOT current_ok AND labeler_ok) AS recovered, count(*) FILTER (NOT current_ok AND labeler_ok AND current_null) AS recovered_missing, count(*) FILTER (NOT current_ok AND labeler_ok AND NOT current_null) AS recovered_wrong
FROM x GROUP BY suite
"""


@query(_ABC)
def q_abc_metrics(spark, sf_dir):
    k = F.col("o_orderkey")
    expected = k.cast("string")
    field = F.lit("total")
    got = lambda m: F.when(k % (2 * m) == 0, F.lit(None)).when(k % m == 0, F.concat(expected, F.lit("x"))).otherwise(expected)
    d = table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), k % 3).alias("suite"), expected.alias("expected"), got(5).alias("current"), got(7).alias("labeler"))
    d = d.withColumns({"current_ok": evaluate.is_match(field, F.col("current"), F.col("expected")), "labeler_ok": evaluate.is_lenient_match(field, F.col("labeler"), F.col("expected"))})
    return evaluate.recovery(d)


@query(base.SQL + ", c AS (SELECT k, bool_or(true) AS e, bool_or(line % 2 = 0) AS h FROM i GROUP BY k) SELECT 's' || k % 3 AS suite, count(*) FILTER (k % 4 <> 0) AS eligible, count(*) FILTER (k % 4 <> 0 AND h) AS ok, count(*) FILTER (k % 4 = 0) AS absent FROM c GROUP BY 1")
def q_labelled_lines(spark, sf_dir):
    """Whether any line with the value has the label: each item's line, found by its amount."""
    k = F.col("k")
    line = F.concat(F.lit("品 "), t.yen(F.col("yen")))
    value = F.when(k % 4 == 0, F.lit("no")).otherwise(F.col("yen").cast("string"))
    d = base.items(spark, sf_dir).select(F.concat(F.lit("s"), k % 3).alias("suite"), k.alias("item"), F.lit("total").alias("field"), evaluate.value_in_line(F.lit("total"), value, line).alias("has_value"), (F.col("line") % 2 == 0).alias("hit"))
    return evaluate.labelled_lines(d)


@query(
    "SELECT o_orderkey AS k, true AS as_slash, true AS as_kanji, (month(o_orderdate) <> 12) AS other_month, true AS as_time FROM orders"
)
def q_value_in_line(spark, sf_dir):
    value = F.date_format("o_orderdate", "yyyy-MM-dd")
    has = lambda text, x=value, f="date": evaluate.value_in_line(F.lit(f), x, text)
    other = ~has(F.concat(F.date_format("o_orderdate", "yyyy/"), F.lit("12/"), F.date_format("o_orderdate", "d")))
    clock = F.format_string("%02d:%02d", F.hour("o_orderdate") + (F.col("o_orderkey") % 20).cast("int"), F.lit(7))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), has(F.date_format("o_orderdate", "yyyy/M/d")).alias("as_slash"), has(F.date_format("o_orderdate", "yyyy年 MM月 d日")).alias("as_kanji"), other.alias("other_month"),
        has(F.concat(F.col("o_orderkey") % 20, F.lit("時 7分")), clock, "time").alias("as_time"),
    )


@query(_FACTS + "SELECT field, '| ' || field || ' | v | ' || CASE WHEN field = 'tax' THEN '❌ w | ❌ (未検出) |' ELSE '✅ v | ❌ (未検出) |' END AS line FROM (SELECT DISTINCT field FROM x) UNION ALL SELECT '~', '| **正解数** | - | **4/9** | **0/9** |'")
def q_markdown_table(spark, sf_dir):
    d = _scored(spark, sf_dir).select("field").distinct().withColumn("expected", F.lit("v"))
    a = d.withColumns({"engine": F.lit("a"), "got": F.when(F.col("field") == "tax", "w").otherwise("v")})
    return evaluate.comparison_table(a.unionByName(d.withColumns({"engine": F.lit("b"), "got": F.lit(None).cast("string")})), ["a", "b"])


@query(base.SQL + "SELECT k, array_to_string(list_sort(list_distinct([t8, t10, t8 + t10])), ',') AS accepted, true AS is_match FROM r")
def q_tax_acceptables(spark, sf_dir):
    both = F.array("t8", "t10")
    ok = readers.accepted_taxes(both)
    d = base.amounts(spark, sf_dir).select("k", ok.alias("ok"), (F.col("t8") + F.col("t10")).alias("got"))
    return d.select("k", F.concat_ws(",", F.col("ok").cast("array<string>")).alias("accepted"), evaluate.is_match(F.lit("tax"), F.col("got"), F.col("got"), F.col("ok")).alias("is_match"))


@query(base.SQL + "SELECT store_brand FROM f GROUP BY store_brand")
def q_distinct_brands(spark, sf_dir):
    d = extract.with_fields(base.rendered(spark, sf_dir), "text", fixed.BRANDS + base.SHOPS).select("store_brand")
    return d.distinct().orderBy("store_brand")


# Arithmetic of receipts


@query(base.SQL + "SELECT k, total, t8 + t10 AS tax FROM r")
def q_tax_inclusive(spark, sf_dir):
    return synth.by_rate(base.items(spark, sf_dir), "k")


@query(base.SQL + "SELECT k, total, a8 * 8 // 100 + a10 * 10 // 100 AS tax FROM r")
def q_tax_exclusive(spark, sf_dir):
    return synth.by_rate(base.items(spark, sf_dir), "k", inside=False)


@query(base.SQL + "SELECT k, total, CASE WHEN total % 100 = 0 AND k % 10 < 7 THEN total + 100 ELSE (total + 99) // 100 * 100 END AS deposit FROM r")
def q_payment(spark, sf_dir):
    return base.amounts(spark, sf_dir).select("k", "total", synth.deposit(F.col("total"), F.lit(100), F.col("k") % 10 < 7).alias("deposit"))


@query(base.SQL + "SELECT k, string_agg('商品' || line || ' ¥' || format('{:,}', yen), chr(10) ORDER BY line) AS text FROM i GROUP BY k")
def q_receipt_text(spark, sf_dir):
    d = base.items(spark, sf_dir).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("line", F.concat(F.lit("商品"), "line", F.lit(" "), t.yen(F.col("yen"))).alias("x")))).alias("all"))
    return d.select("k", F.array_join(F.transform("all", lambda a: a["x"]), "\n").alias("text"))


@query("SELECT p_partkey, ('0x' || substr(sha256(p_name), 1, 12))::BIGINT AS seed FROM part")
def q_seed_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", synth.name_seed(F.col("p_name")).alias("seed"))


@query("SELECT p_name AS image, strength, p_name || '_' || strength || '.jpg' AS output FROM (SELECT DISTINCT p_name FROM part), (SELECT unnest(['light', 'medium', 'heavy']) AS strength)")
def q_strength_cross(spark, sf_dir):
    return synth.degradations(table(spark, sf_dir, "part").select(F.col("p_name").alias("image")).distinct())


@query("SELECT 'i' || p_partkey || '.png' AS image, strength, 'i' || p_partkey || '_' || strength || '.jpg' AS output, s_suppkey AS case_id FROM part CROSS JOIN (SELECT unnest(['light', 'medium', 'heavy']) AS strength) LEFT JOIN supplier ON p_partkey = s_suppkey * 3")
def q_manifest_left_join(spark, sf_dir):
    """Images at every strength, with their cases where the manifest has them."""
    name = lambda k: F.concat(F.lit("i"), k, F.lit(".png")).alias("image")
    manifest = table(spark, sf_dir, "supplier").select(name(F.col("s_suppkey") * 3), F.col("s_suppkey").alias("case_id"))
    return synth.degradations(table(spark, sf_dir, "part").select(name(F.col("p_partkey"))), manifest)


@query("SELECT p_partkey, ('0x' || substr(sha256('42:' || p_name || ':heavy'), 1, 12))::BIGINT AS seed FROM part")
def q_degradation_seed(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", synth.degradation_seed(F.col("p_name"), F.lit("heavy")).alias("seed"))


@query("SELECT (['conv', 'super', 'dining', 'service'])[o_orderkey % 4 + 1] AS template, count(*) AS n, count(*) AS n_ok FROM orders GROUP BY 1")
def q_generated_receipts(spark, sf_dir):
    """A generated receipt an order: how many print what they hold, and give it back when read."""
    fields = [f for f in fixed.FIELDS if f != "store_branch"]
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).repartition(4 * spark.sparkContext.defaultParallelism, "id")  # narrow rows, much work: their bytes would give few tasks
    made = synth.receipts(ids)
    d = made.select("id", "template", "text", F.struct(*fields).alias("true"))
    read = extract.with_fields(d, "text", fixed.BRANDS + base.SHOPS)
    return read.groupBy("template").agg(F.count("*").alias("n"), F.count_if(F.col("true").eqNullSafe(F.struct(*fields))).alias("n_ok"))


# Sources, caches, statistics


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_cache_missing(spark, sf_dir):
    return readers.missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("WITH u AS (SELECT DISTINCT user_id, event_id % 50 AS idx FROM events), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY idx) - 1 AS pos FROM u) SELECT user_id, idx FROM p WHERE pos = idx")
def q_asset_gap(spark, sf_dir):
    return readers.until_gap(table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 50).alias("idx")), "user_id")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(max(value), 6) AS max, round(sum(value) / sum(user_id), 9) AS per_unit FROM events GROUP BY event_type")
def q_latency_stats(spark, sf_dir):
    d = bench.latency(table(spark, sf_dir, "events"), "event_type", "value", "user_id")
    return d.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "max")), F.round("per_unit", 9).alias("per_unit"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(max(value), 6) AS max FROM events WHERE event_id > 0 GROUP BY event_type")
def q_warm_latency(spark, sf_dir):
    d = bench.warm(table(spark, sf_dir, "events"), "event_type", "value", "event_id")
    return d.select("event_type", F.round("mean", 6).alias("mean"), F.round("max", 6).alias("max"))


@query('WITH p AS (SELECT quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.95) AS p95, quantile_cont(n_chars, 0.99) AS p99, max(n_chars) AS max FROM documents) SELECT p50, p95, round(p99, 6) AS p99, max, ceil(p99)::BIGINT + 10 AS "limit", round((SELECT avg((n_chars > ceil(p99) + 10)::INT) FROM documents), 9) AS cut FROM p')
def q_token_percentiles(spark, sf_dir):
    d = bench.lengths(table(spark, sf_dir, "documents"), "n_chars")
    return d.select("p50", "p95", F.round("p99", 6).alias("p99"), "max", "limit", F.round("cut", 9).alias("cut"))


@query("SELECT l_orderkey, round(coalesce(avg(l_discount) FILTER (l_returnflag <> 'N'), 0), 9) AS confidence FROM lineitem GROUP BY l_orderkey")
def q_mean_confidence(spark, sf_dir):
    chances = F.collect_list(F.when(F.col("l_returnflag") != "N", F.col("l_discount")))  # of one text
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(chances.alias("c")).select("l_orderkey", F.round(evaluate.confidence(F.col("c")), 9).alias("confidence"))


@query("SELECT l_orderkey, median(l_quantity) AS tilt, abs(median(l_quantity)) > 15 AS rejected FROM lineitem GROUP BY l_orderkey")
def q_median_tilt(spark, sf_dir):
    return bench.tilt(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", fixed.TILT)


_QUALITY = """
WITH m AS (SELECT event_id, event_id % 900 + 100 AS edge, user_id % 260 AS light, value AS sharp, event_id % 40 - 20 AS tilt FROM events),
c AS (SELECT *, list_filter([CASE WHEN edge < 400 THEN 'low_resolution' END, CASE WHEN edge BETWEEN 400 AND 639 THEN 'small' END, CASE WHEN light < 60 THEN 'dark' END, CASE WHEN light > 220 THEN 'bright' END,
  CASE WHEN sharp < 50 THEN 'blur' END, CASE WHEN abs(tilt) > 15 THEN 'tilt' END], lambda x: x IS NOT NULL) AS codes, edge >= 400 AND light >= 60 AND abs(tilt) <= 15 AS ok FROM m)
SELECT event_id, ok, array_to_string(CASE WHEN ok THEN codes ELSE ['guide'] || codes || list_filter([CASE WHEN list_contains(codes, 'dark') THEN '-> brighter place' END, CASE WHEN list_contains(codes, 'bright') THEN '-> no direct sun' END,
  CASE WHEN list_contains(codes, 'low_resolution') THEN '-> move closer' END, CASE WHEN list_contains(codes, 'blur') THEN '-> hold still' END, CASE WHEN list_contains(codes, 'tilt') THEN '-> straighten' END], lambda x: x IS NOT NULL) END, ';') AS messages FROM c
"""


@query(_QUALITY)
def q_quality_gate(spark, sf_dir):
    e = F.col("event_id")
    d = table(spark, sf_dir, "events").select("event_id", quality.findings(e % 900 + 100, F.lit(5000), F.col("user_id") % 260, F.col("value"), e % 40 - 20).alias("f"))
    return d.select("event_id", quality.accepted(F.col("f")).alias("ok"), F.concat_ws(";", quality.messages(F.col("f"))).alias("messages"))


@query("SELECT event_id, NOT (user_id % 200 >= 100 OR event_id % 1000 < 100 OR value / 100 < 0.32) AS enhance FROM events")
def q_enhancement_gate(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", quality.needs_enhancement(F.col("user_id") % 200, F.col("event_id") % 1000, F.col("value") / 100).alias("enhance"))


@query(base.SQL + ", c AS (SELECT k, suite, n FROM (SELECT k, 's' || k % 3 AS suite, n FROM r)) SELECT suite, count(*) AS items, sum(n)::BIGINT AS lines FROM (SELECT * FROM c UNION ALL SELECT k, 'real', n FROM r) GROUP BY suite")
def q_suite_union(spark, sf_dir):
    d = base.amounts(spark, sf_dir).select("k", "n")
    both = d.withColumn("suite", F.concat(F.lit("s"), F.col("k") % 3)).unionByName(d.withColumn("suite", F.lit("real")))
    return both.groupBy("suite").agg(F.count("*").alias("items"), F.sum("n").alias("lines"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r <= 2")
def q_top_lines(spark, sf_dir):
    """The two dearest lines of each receipt."""
    return bench.top(table(spark, sf_dir, "lineitem"), "l_orderkey", 2, F.desc("l_extendedprice"), F.col("l_linenumber")).select("l_orderkey", "l_linenumber", "l_partkey")
