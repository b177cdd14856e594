"""Result comparison, metrics, difficulty, paired tests and report tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


@dataclass(frozen=True)
class Comparison:
    """How cells compare. The strict preset keeps case, spaces and exact numbers."""

    eps: float = 1e-6
    fold: bool = True
    ordered_lists: bool = False
    keep_columns: bool = False


STRICT = Comparison(eps=0.0, fold=False)


def cell(x: Column, kind: T.DataType, how: Comparison = Comparison()) -> Column:
    """A value's canonical text, by its type: numbers snapped, texts trimmed and lowered,
    times in ISO form, lists sorted unless their order counts, nodes and maps by sorted
    keys without their ids."""
    null = lambda c: F.coalesce(c, F.lit("~"))
    if isinstance(kind, T.BooleanType):
        return null(F.concat(F.lit("b:"), x.cast("string")))
    if isinstance(kind, T.NumericType):
        y = X.snap(x.cast("double"), how.eps)
        return null(F.concat(F.lit("n:"), F.when(y == 0, F.lit(0.0)).otherwise(y).cast("string")))
    if isinstance(kind, T.StringType):
        return null(F.concat(F.lit("s:"), F.lower(F.trim(x)) if how.fold else x))
    if isinstance(kind, T.DateType):
        return null(F.concat(F.lit("t:"), F.date_format(x, "yyyy-MM-dd")))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return null(F.concat(F.lit("t:"), F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    if isinstance(kind, T.ArrayType):
        items = F.transform(x, lambda c: cell(c, kind.elementType, how))
        return null(F.concat(F.lit("["), F.array_join(items if how.ordered_lists else F.array_sort(items), ","), F.lit("]")))
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f"{n}="), cell(x[n], kind[n].dataType, how)) for n in sorted(kind.names) if n not in ("_id", "_eid")]
        return F.when(x.isNull(), "~").otherwise(F.concat(F.lit("{"), F.array_join(F.array(*parts), ","), F.lit("}")))
    return null(x.cast("string"))


def signature(df: DataFrame, how: Comparison = Comparison()) -> DataFrame:
    """(sig): each row's cells in sorted order; names don't count unless they are kept."""
    cells = [cell(F.col(f"`{f.name}`"), f.dataType, how) for f in df.schema]
    if how.keep_columns:
        cells = [F.concat(F.lit(f"{f.name}:"), c) for f, c in zip(df.schema, cells)]
    return df.select(F.array_join(F.array_sort(F.array(*cells)), "|").alias("sig"))


def same_results(pred: DataFrame, gold: DataFrame, how: Comparison = Comparison()) -> DataFrame:
    """(ea): whether both have the same rows as often; one shuffle of row signatures. Two
    empty results are equal; different widths are unequal unless one is empty."""
    rows = signature(pred, how).withColumn("d", F.lit(1)).union(signature(gold, how).withColumn("d", F.lit(-1)))
    net = rows.groupBy("sig").agg(F.sum("d").alias("d"))
    return net.agg((F.coalesce(F.max(F.abs("d")), F.lit(0)) == 0).alias("ea"))


def same_sequence(pred: DataFrame, gold: DataFrame, order: str, how: Comparison = Comparison()) -> DataFrame:
    """(ea): whether both lists of rows, numbered by the column ``order``, are equal."""
    number = lambda df: df.select(F.col(order).alias("i"), F.array_join(F.array_sort(F.array(*[cell(F.col(f.name), f.dataType, how) for f in df.schema if f.name != order])), "|").alias("sig"))
    both = number(pred).alias("a").join(number(gold).alias("b"), "i", "full")
    return both.agg((F.coalesce(F.sum((~F.col("a.sig").eqNullSafe(F.col("b.sig"))).cast("int")), F.lit(0)) == 0).alias("ea"))


def per_query_ea(pred: DataFrame, gold: DataFrame, key: str = "qid", how: Comparison = Comparison()) -> DataFrame:
    """(qid, ea) for many queries at once: rows are (qid, columns ...)."""

    def rows(df: DataFrame, d: int) -> DataFrame:
        cells = [cell(F.col(f"`{f.name}`"), f.dataType, how) for f in df.schema if f.name != key]
        return df.select(key, F.array_join(F.array_sort(F.array(*cells)), "|").alias("sig"), F.lit(d).alias("d"))

    net = rows(pred, 1).union(rows(gold, -1)).groupBy(key, "sig").agg(F.sum("d").alias("d"))
    return net.groupBy(key).agg((F.max(F.abs("d")) == 0).alias("ea"))


def exact_match(pred: Column, gold: Column) -> Column:
    """Null gold: null; null prediction: false."""
    return F.when(gold.isNotNull(), F.coalesce(X.query_normal(pred) == X.query_normal(gold), F.lit(False)))


def jaccard(pred: DataFrame, gold: DataFrame, key: str = "qid", item: str = "id") -> DataFrame:
    """(qid, inter, both, psjs) of the distinct provenance ids of each query; no ids on
    either side leaves psjs null, for the caller's fallback."""
    rows = pred.select(key, item, F.lit(1).alias("p")).union(gold.select(key, item, F.lit(2)))
    each = rows.groupBy(key, item).agg((F.max((F.col("p") == 1).cast("int")) + 2 * F.max((F.col("p") == 2).cast("int"))).alias("m"))
    out = each.where(f"{item} is not null").groupBy(key).agg(F.sum((F.col("m") == 3).cast("int")).alias("inter"), F.count("*").alias("both"))
    return out.withColumn("psjs", F.round(F.try_divide(F.col("inter"), F.col("both")), 6))


def psjs_score(pred: Column, gold: Column, jaccard_: Column, ea: Column, failed: Column) -> Column:
    """Null gold: null; blank prediction or failure: 0; same text: 1; no ids: by EA."""
    return (
        F.when(gold.isNull(), None).when(pred.isNull() | (F.trim(pred) == "") | failed, 0.0).when(X.query_normal(pred) == X.query_normal(gold), 1.0)
        .otherwise(F.coalesce(jaccard_, F.when(ea, 1.0).otherwise(0.0)))
    )


# difficulty, by the text of a query
#: Words that begin a clause.
CLAUSES = (
    "OPTIONAL MATCH", "MATCH", "DETACH DELETE", "DELETE", "ORDER BY", "UNION ALL", "UNION", "WHERE", "RETURN", "WITH", "CREATE", "SET", "MERGE", "UNWIND",
    "LIMIT", "SKIP", "FOREACH", "CALL", "YIELD", "REMOVE", "USING",
)
AGGREGATE = r"(?i)\b(?:COUNT|SUM|AVG|MIN|MAX|COLLECT)\s*\("
SUBQUERY = r"(?i)\b(?:CALL|EXISTS|COUNT|COLLECT)\s*\{"


def _count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern))


def clauses(stripped: Column) -> Column:
    """array of (word, body): each clause, to the next one's word, wherever it stands."""
    words = "|".join(c.replace(" ", r"\s+") for c in CLAUSES)
    marked = F.regexp_replace(stripped, rf"(?i)\b({words})\b", "\x01$1\x02")
    parts = F.filter(F.split(marked, "\x01"), lambda x: x.contains("\x02"))
    word = lambda x: F.upper(F.regexp_replace(F.substring_index(x, "\x02", 1), r"\s+", " "))
    return F.transform(parts, lambda x: F.struct(word(x).alias("word"), F.substring_index(x, "\x02", -1).alias("body")))


def _bodies(found: Column, *words: str) -> Column:
    return F.transform(F.filter(found, lambda c: c["word"].isin(*words)), lambda c: c["body"])


def top_level(body: Column) -> Column:
    """The parts between commas that no bracket holds."""
    zero = F.struct(F.lit(0).alias("round"), F.lit(0).alias("square"), F.lit(0).alias("curly"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        depth = {k: acc[k] + (c == o).cast("int") - (c == e).cast("int") for k, o, e in (("round", "(", ")"), ("square", "[", "]"), ("curly", "{", "}"))}
        free = (c == ",") & (acc["round"] == 0) & (acc["square"] == 0) & (acc["curly"] == 0)
        return F.struct(*[v.alias(k) for k, v in depth.items()], F.concat(acc["out"], F.when(free, "\x01").otherwise(c)).alias("out"))

    return F.split(F.aggregate(F.split(body, ""), zero, step, lambda acc: acc["out"]), "\x01")


def nested_subquery(stripped: Column) -> Column:
    """Whether a subquery's braces stand within another's; braces of maps don't count."""
    braces = F.regexp_extract_all(stripped, F.lit(SUBQUERY + r"|\{|\}"), F.lit(0))
    zero = F.struct(F.lit("").alias("open"), F.lit(False).alias("nested"))

    def step(acc: Column, x: Column) -> Column:
        kind = F.when(F.length(x) > 1, "s").otherwise("m")
        now = F.when(x == "}", F.substring(acc["open"], F.lit(1), F.greatest(F.length(acc["open"]) - 1, F.lit(0)))).otherwise(F.concat(acc["open"], kind))
        return F.struct(now.alias("open"), (acc["nested"] | now.rlike("s.*s")).alias("nested"))

    return F.aggregate(braces, zero, step, lambda acc: acc["nested"])


def difficulty(query: Column) -> Column:
    """struct(reach, op, filter, total, level): points for the longest path, the hardest
    operation, and the predicates of all WHERE clauses and property maps; 0 easy, 1 and 2
    medium, 3 on hard. A subquery within another, or a union with a path of two hops, is
    hard whatever the total. No query, or a blank one: null."""
    s = X.stripped_query(query)
    found = clauses(s)
    patterns, wheres = _bodies(found, "MATCH", "OPTIONAL MATCH"), _bodies(found, "WHERE")
    most = lambda a: F.coalesce(F.array_max(a), F.lit(0))
    hops = most(F.transform(patterns, lambda p: most(F.transform(top_level(p), lambda x: _count(x, r"<?-(?:\[[^\]]*\])?->?")))))
    reach = F.when(s.rlike(r"\[[^\]]*\*[^\]]*\]") | (hops >= 4), 2).when(hops >= 2, 1).otherwise(0)

    def grouped(body: Column) -> Column:
        parts = top_level(body)
        return F.exists(parts, lambda x: x.rlike(AGGREGATE)) & F.exists(parts, lambda x: ~x.rlike(AGGREGATE))

    ordered, union = s.rlike(r"(?i)\bORDER\s+BY\b"), s.rlike(r"(?i)\bUNION(?:\s+ALL)?\b")
    hard = F.exists(_bodies(found, "RETURN", "WITH"), grouped) | (ordered & s.rlike(r"(?i)\bLIMIT\s+1\b(?!\s*\d)")) | s.rlike(r"(?i)\bCASE\s+WHEN\b") | union | s.rlike(SUBQUERY)
    some = s.rlike(AGGREGATE) | ordered | s.rlike(r"(?i)\bLIMIT\b|\bSKIP\b|\bOPTIONAL\s+MATCH\b|\bUNWIND\b|\b(?:shortestPath|allShortestPaths)\s*\(")
    op = F.when(hard, 2).when(some, 1).otherwise(0)
    ands, ors = (lambda x: _count(x, r"(?i)\bAND\b")), (lambda x: _count(x, r"(?i)\bOR\b"))
    total_of = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + x)
    predicates = total_of(F.transform(wheres, lambda x: 1 + ands(x) + ors(x))) + total_of(F.transform(patterns, lambda x: _count(x, r"[A-Za-z0-9_)\]]\s*\{")))
    mixed = F.exists(wheres, lambda x: (ands(x) > 0) & (ors(x) > 0))
    filters = F.when(mixed | (predicates >= 3), 2).when(predicates == 2, 1).otherwise(0)
    total = reach + op + filters
    level = F.when(nested_subquery(s) | (union & (hops >= 2)) | (total >= 3), "hard").when(total >= 1, "medium").otherwise("easy")
    made = F.struct(reach.alias("reach"), op.alias("op"), filters.alias("filter"), total.alias("total"), level.alias("level"))
    return F.when(query.rlike(r"\S"), made)


def strategy_of(meta: Column) -> Column:
    """The strategy of the first edit of a row's nested metadata; null where there is none."""
    return F.get(meta["edits"], F.lit(0))["strategy"]


def stale(ea: Column, rule: Column, chain: Column, current: str) -> Column:
    """Whether a verdict of a chain run was made under another rule for rows than ``current``."""
    return F.coalesce(chain, F.lit(False)) & ea.isNotNull() & ~rule.eqNullSafe(F.lit(current))


def rater_files(rows: DataFrame, queues: DataFrame, calibration: DataFrame, raters: str = "ABCDE") -> DataFrame:
    """(file, rater, kind, how) of the annotation rows (file, id, annotator). The rater is what the
    column names, if it is one; else whose queue (rater, id) has the same ids; else the letter
    in the file's name; else null. Files of the calibration's ids, or of fewer than 100 rows,
    are calibration; a file known by its queue is main."""
    named = F.upper(F.trim("annotator"))
    files = rows.groupBy("file").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.array_sort(F.collect_set(F.when(named != "", named))).alias("names"))
    different = rows.select("file", "id").distinct()
    sizes = queues.groupBy("rater").agg(F.countDistinct("id").alias("size"))
    whole = different.join(queues.distinct(), "id").groupBy("file", "rater").agg(F.count("*").alias("met")).join(sizes, "rater")
    queue = whole.join(files.select("file", "ids"), "file").where("met = size and met = ids").groupBy("file").agg(F.min("rater").alias("queue"))
    tested = different.join(calibration.select("id").distinct().withColumn("c", F.lit(1)), "id", "left").groupBy("file").agg(F.count("c").alias("c"))
    size = calibration.agg(F.countDistinct("id").alias("size"))
    met = files.join(queue, "file", "left").join(tested, "file").join(F.broadcast(size))  # one row
    base = F.regexp_extract("file", r"[^/]*$", 0)
    letter = F.upper(F.coalesce(F.nullif(F.regexp_extract(base, rf"annotator[_ -]?([{raters}{raters.lower()}])\b", 1), F.lit("")), F.nullif(F.regexp_extract(base, rf"[_ -]([{raters}])\.csv$", 1), F.lit(""))))
    column = F.when((F.size("names") == 1) & F.get("names", F.lit(0)).isin(*raters), F.get("names", F.lit(0)))
    small = ((F.col("c") == F.col("size")) & (F.col("ids") == F.col("size"))) | (F.col("n") < 100)
    how = F.when(column.isNotNull(), "column").when(F.col("queue").isNotNull(), "queue").when(letter.isNotNull(), "name").otherwise("unknown")
    return met.select("file", F.coalesce(column, "queue", letter).alias("rater"), F.when(small & (how != "queue"), "calibration").otherwise("main").alias("kind"), how.alias("how"))


def has_order_by(query: Column) -> Column:
    """At the level of the query itself: inside CALL { } it doesn't count."""
    return F.regexp_replace(X.stripped_query(query), r"(?is)\bCALL\s*\{[^{}]*\}", " ").rlike(r"(?i)\bORDER\s+BY\b")


# tables of records
def bucket_means(records: DataFrame, bucket: str = "bucket") -> DataFrame:
    """(bucket, n, ea, psjs) for every bucket and for all; what has no verdict scores 0,
    what has no bucket counts only to all."""
    score = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6)
    rows = records.withColumn("b", F.explode(F.array_compact(F.array(F.lit("all"), F.col(bucket)))))
    return rows.groupBy(F.col("b").alias("bucket")).agg(F.count("*").alias("n"), score(F.col("ea").cast("double")).alias("ea"), score(F.col("psjs")).alias("psjs"))


def paired_flips(a: DataFrame, b: DataFrame, key: str = "qid") -> DataFrame:
    """(n, both, lost, won, neither, delta): verdicts of the same questions under two
    conditions; null counts as wrong."""
    x, y = F.coalesce(F.col("a.ea"), F.lit(False)), F.coalesce(F.col("b.ea"), F.lit(False))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    both = a.select(key, "ea").alias("a").join(b.select(key, "ea").alias("b"), key)
    return both.agg(F.count("*").alias("n"), n(x & y, "both"), n(x & ~y, "lost"), n(~x & y, "won"), n(~x & ~y, "neither"), F.round(F.avg(y.cast("double")) - F.avg(x.cast("double")), 6).alias("delta"))


def sign_test(k: Column, n: Column) -> Column:
    """Two-sided exact sign test for the smaller count k of n flips: min(1, 2 * sum of
    C(n, i) / 2^n for i up to k), in log space; no flips: 1."""
    low = F.least(k, n - k).cast("long")
    zero = F.struct(F.lit(0.0).alias("c"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        c = acc["c"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(c.alias("c"), (acc["s"] + F.exp(c - n * F.log(F.lit(2.0)))).alias("s"))

    places = F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(low, F.lit(0))), lambda i: i > 0)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(places, zero, step, lambda acc: acc["s"])))


def pooled(cells: DataFrame) -> DataFrame:
    """(micro, macro) of cells (value, n); cells without a value or rows don't count."""
    kept = cells.where("value is not null and n > 0")
    return kept.agg(F.round(F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum("n")), 6).alias("micro"), F.round(F.avg("value"), 6).alias("macro"))


def failure_bucket(pred_values: Column, gold_values: Column, pred_types: Column, gold_types: Column, psjs: Column) -> Column:
    """The first difference between two queries: values, then structure, then how much of
    the answer is there."""
    differ = lambda a, b: (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)
    return (
        F.when(psjs >= 0.99, "ok").when(differ(pred_values, gold_values), "value").when(differ(pred_types, gold_types), "relationship")
        .when(psjs >= 0.8, "partial").otherwise("structure")
    )


def failure_mode(ea: Column, rows: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), "error").when(ea, "correct").when(rows == 0, "wrong_empty").otherwise("wrong_nonempty")


def latest(runs: DataFrame, keys: list[str], stamp: str = "stamp") -> DataFrame:
    """The newest run of each key; ties by all columns."""
    order = Window.partitionBy(*keys).orderBy(F.desc(stamp), *[c for c in runs.columns if c not in keys and c != stamp])
    return runs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def without_retired(records: DataFrame, retired: DataFrame) -> DataFrame:
    """Retired rows go only if id and text are both the same (null equal to null)."""
    a, b = records.alias("a"), retired.alias("b")
    return a.join(b, F.col("a.qid").eqNullSafe(F.col("b.qid")) & F.col("a.text").eqNullSafe(F.col("b.text")), "left_anti")


def gold_dedup(errors: DataFrame) -> DataFrame:
    """One row for each (graph, qid): the first error by stamp, and all methods."""
    return errors.groupBy("graph", "qid").agg(F.min_by("error", "stamp").alias("error"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(rho, n) with average ranks; fewer than two rows or no spread: 0."""

    # ranks come from counts of values below, so no window holds all rows
    counts = lambda c: df.groupBy(c).agg(F.count("*").alias("k"))

    def average_ranks(c: str, name: str) -> DataFrame:
        k = counts(c)
        bins = k.select(F.col(c), "k", F.sum("k").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)).alias("below"))
        return bins.select(F.col(c), (F.coalesce("below", F.lit(0)) + (F.col("k") + 1) / 2).alias(name))

    kept = df.where(f"{a} is not null and {b} is not null")
    rows = kept.join(average_ranks(a, "_ra"), a).join(average_ranks(b, "_rb"), b)
    spread = (F.count("*") < 2) | (F.coalesce(F.var_pop("_ra"), F.lit(0.0)) == 0) | (F.coalesce(F.var_pop("_rb"), F.lit(0.0)) == 0)
    return rows.agg(F.round(F.when(spread, 0.0).otherwise(F.corr("_ra", "_rb")), 6).alias("rho"), F.count("*").alias("n"))


def acceptable(records: DataFrame, bucket: str = "bucket", low: float = 0.05, high: float = 0.75) -> DataFrame:
    """Each bucket's share and whether it lies within the bounds."""
    total = records.where(f"{bucket} is not null").agg(F.count("*").alias("all"))
    rows = records.where(f"{bucket} is not null").groupBy(bucket).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    return rows.select(bucket, "n", F.round(F.col("n") / F.col("all"), 6).alias("share"), (F.col("n") / F.col("all")).between(low, high).alias("ok"))


def rescored(records: DataFrame, keep: DataFrame) -> DataFrame:
    """(part, n, ea, psjs) before and after rows with a known verdict other than keep are
    dropped; rows without one are kept and counted as unmatched."""
    rows = records.join(keep, ["graph", "qid"], "left")
    score = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6)
    aggs = [F.count("*").alias("n"), score(F.col("ea").cast("double")).alias("ea"), score(F.col("psjs")).alias("psjs"), F.count(F.when(F.col("keep").isNull(), 1)).alias("unmatched")]
    after = rows.where("keep is null or keep")
    return rows.agg(F.lit("before").alias("part"), *aggs).union(after.agg(F.lit("after").alias("part"), *aggs))


def method_matrix(cells: DataFrame, known: list[str]) -> DataFrame:
    """methods by buckets, the known buckets in their order; an empty cell is null."""
    return cells.groupBy("method").pivot("bucket", known).agg(F.round(F.avg("value"), 6))


def error_split(records: DataFrame) -> DataFrame:
    none = records.where("ea is null")
    gold = F.coalesce(F.col("error").startswith("gold:"), F.lit(False))
    return none.groupBy("graph").agg(F.count(F.when(gold, 1)).alias("gold_failed"), F.count(F.when(~gold, 1)).alias("method_failed"))


def run_verdicts(runs: DataFrame, released: DataFrame) -> DataFrame:
    """A verdict for each run of (graph, strategy, stamp, n): outside, delete, check, older,
    partial or keep; the first that applies."""
    own = Window.partitionBy("graph", "strategy")
    rows = runs.join(released.select("graph", F.col("n").alias("released")), "graph", "left")
    full = F.col("n") == F.col("released")
    newest = F.max(F.when(full, F.col("stamp"))).over(own)
    verdict = (
        F.when(F.col("released").isNull(), "outside").when(F.col("n") == 0, "delete").when(F.col("n") > F.col("released"), "check")
        .when(full & (F.col("stamp") < newest), "older").when(~full, "partial").otherwise("keep")
    )
    return rows.select("graph", "strategy", "stamp", "n", verdict.alias("verdict"))


def executability(records: DataFrame, released: DataFrame) -> DataFrame:
    """Per graph with a complete run: errors, timeouts and empty answers."""
    rows = records.groupBy("graph").agg(F.count("*").alias("n"), F.count("error").alias("errors"), F.count(F.when(F.col("error").contains("timed out"), 1)).alias("timeouts"), F.count(F.when(F.col("rows") == 0, 1)).alias("empty"))
    return rows.join(released.select("graph", F.col("n").alias("want")), "graph").where("n = want").drop("want")


def rejudged(records: DataFrame, fresh: DataFrame, stale: Column) -> DataFrame:
    """Stale records take a fresh verdict where there is one; all others stay as they are."""
    new = fresh.select("qid", F.col("ea").alias("_ea"))
    return records.join(new, "qid", "left").withColumn("ea", F.when(stale & F.col("_ea").isNotNull(), F.col("_ea")).otherwise(F.col("ea"))).drop("_ea")


def grounding_class(mention: Column, value: Column) -> Column:
    """How a mention can be linked: same text whatever the case, at most two edits
    (neighbours' swaps count once), the value contains it, else meaning."""
    m, v = F.lower(mention), F.lower(value)
    near = (F.abs(F.length(mention) - F.length(value)) <= 2) & (X.osa_distance(mention, value) <= 2)
    return F.when(m == v, "exact_ci").when(near, "edit_distance").when(F.contains(v, m), "substring").otherwise("semantic")


def markdown(rows: list, columns: list[str]) -> str:
    """An aligned table of a few collected rows."""
    cells = [[("" if r[c] is None else f"{r[c]:.3f}" if isinstance(r[c], float) else str(r[c])) for c in columns] for r in rows]
    widths = [max(len(c), *(len(r[i]) for r in cells), 3) if cells else max(len(c), 3) for i, c in enumerate(columns)]
    line = lambda r: "| " + " | ".join(x.ljust(w) for x, w in zip(r, widths)) + " |"
    return "\n".join([line(columns), "|" + "|".join("-" * (w + 2) for w in widths) + "|", *map(line, cells)])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
