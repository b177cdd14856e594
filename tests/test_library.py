"""Functions, retrieval, evaluation, statistics, sampling, augmentation and sources."""

import io
import itertools
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.udf import jaro_winkler_similarity, osa, osa_distance, spliced, word_occurrences
from lodestone.operators import augment, evaluate, grounding, retrieval, sampling, stats
from lodestone.sources import io as sources
from lodestone.streaming import monitor


def test_osa_expression_is_the_plain_distance(spark):
    rng = random.Random(1)
    words = ["", "ca", "abc"] + ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    pairs = list(itertools.product(words[:20], words[20:])) + [("ca", "abc"), ("", ""), ("ab", "ba")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", X.osa_distance(F.col("a"), F.col("b")).alias("e"), osa("a", "b").alias("u")).collect():
        assert r.e == r.u == osa_distance(r.a, r.b)
    assert osa_distance("ca", "abc") == 3


@given(st.text("abcd", max_size=8), st.text("abcd", max_size=8))
@settings(max_examples=200, deadline=None)
def test_distances_are_symmetric(a, b):
    assert osa_distance(a, b) == osa_distance(b, a) and (osa_distance(a, b) == 0) == (a == b)
    assert 0 <= jaro_winkler_similarity(a, b) <= 1


def test_lev_similarity_edges(spark):
    df = spark.createDataFrame([("", " "), ("A", " a "), ("ab", "cd"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(X.lev_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, 0.0, None]


def test_splicing():
    assert spliced("an old car", "old car", "new car") == "a new car" and spliced("a car", "car", "apple") == "an apple"
    assert spliced("the cat", "cat", "the dog") == "the dog" and spliced("scar", "car", "x") is None
    assert spliced("the the cat", "cat", "dog") is None  # an article is doubled
    assert spliced("An old car", "old car", "the apple") == "An apple" and spliced("a cat", "cat", "the") is None
    assert spliced("Bank of Rome today", "Rome", "of Rome") == "Bank of Rome today" and spliced("in Rome city", "Rome", "Rome city") == "in Rome city "
    assert spliced("see it", "it", "x x") is None and spliced("so so it", "it", "x x") == "so so x x"
    assert word_occurrences("Cats and cat", "cat") == [(0, 3), (9, 12)]


def test_signatures_meet_within_one_edit(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(60)})
    field = lambda n: F.lit(n)
    q = spark.createDataFrame([(w,) for w in words[:20]], "q string").select(field("L").alias("label"), field("p").alias("prop"), "q")
    k = spark.createDataFrame([(w,) for w in words], "token string").select(field("L").alias("label"), field("p").alias("prop"), "token")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    got = {(r.q, r.token) for r in retrieval.close_tokens(q, k).collect()}
    assert got == {(a, b) for a in words[:20] for b in words if lev(a, b) <= 1}


def ranked_list(spark, rows):
    return spark.createDataFrame(rows, "qid int, value string, score double, rank int")


def test_fusion(spark):
    a = ranked_list(spark, [(1, "x", 3.0, 1), (1, "y", 2.0, 2)])
    b = ranked_list(spark, [(1, "z", 9.0, 1), (1, "y", 1.0, 2), (2, "w", 1.0, 1)])
    top = lambda d: [(r.qid, r.value) for r in d.orderBy("qid", "rank").collect()]
    assert top(retrieval.cascade(a, b)) == [(1, "x"), (1, "y"), (1, "z"), (2, "w")]
    assert top(retrieval.reciprocal_rank(a, b)) == [(1, "y"), (1, "x"), (1, "z"), (2, "w")]
    assert top(retrieval.reciprocal_rank(b, a)) == top(retrieval.reciprocal_rank(a, b))
    assert top(retrieval.weighted(a, b)) == [(1, "x"), (1, "z"), (1, "y"), (2, "w")]
    assert top(retrieval.fused(a, b, "nonsense")) == top(retrieval.cascade(a, b))
    assert top(retrieval.union_in_order(b, a)) == [(1, "z"), (1, "y"), (1, "x"), (2, "w")]


def test_blank_phrases_and_empty_values(spark):
    values = spark.createDataFrame([("L", "p", "red car"), ("L", "p", "blue car")], "label string, prop string, value string")
    asked = spark.createDataFrame([(1, "  ", "L", "p"), (2, "carr", "L", "p"), (3, "carr", "L", "q")], "qid int, phrase string, label string, prop string")
    assert {r.qid for r in retrieval.search(values, asked).collect()} == {2}
    assert retrieval.search(values.where("false"), asked).count() == 0
    df = spark.createDataFrame([("", ["x"]), ("Car!", ["my car"]), ("bus", ["car"]), ("bus", ["--"])], "m string, v array<string>")
    assert [r[0] for r in df.select(grounding.grounded(F.col("m"), F.col("v"))).collect()] == [False, True, False, True]


def test_comparison_is_blind_to_order_of_rows_and_columns(spark):
    rng = random.Random(3)
    rows = [(i, f"v{i % 3}", float(i) / 3, [i, i + 1]) for i in range(30)]
    gold = spark.createDataFrame(rows, "a int, b string, c double, d array<int>")
    rng.shuffle(rows)
    other = spark.createDataFrame([(r[2] + 1e-9, r[1].upper(), r[3][::-1], float(r[0])) for r in rows], "q double, w string, e array<int>, r double")
    same = lambda a, b, *how: evaluate.same_results(a, b, *how).first().ea
    assert same(other, gold) and same(gold, other) and not same(other, gold, evaluate.STRICT) and not same(gold.limit(29), gold)
    flags = lambda x: spark.createDataFrame([(x,)], "x boolean" if isinstance(x, bool) else "x int")
    assert not same(flags(True), flags(1))


def test_psjs_rules(spark):
    rows = [(1, None, "g", 0.5, True, False), (2, "p", None, 0.5, True, False), (3, "p", "g", 0.5, True, True), (4, "g ", "g", 0.1, False, False), (5, "p", "g", 0.25, False, False), (6, "p", "g", None, True, False)]
    df = spark.createDataFrame(rows, "i int, p string, g string, j double, ea boolean, f boolean")
    got = [r[0] for r in df.orderBy("i").select(evaluate.psjs_score(*map(F.col, ("p", "g", "j", "ea", "f")))).collect()]
    assert got == [0.0, None, 0.0, 1.0, 0.25, 1.0]


def test_statistics_on_nothing(spark):
    none = spark.createDataFrame([], "item int, annotator string, label string")
    assert stats.krippendorff_alpha(none).first().alpha is None and stats.gwet_ac1(none).first().ac1 is None and stats.cohen_kappa(none).count() == 0
    same = spark.createDataFrame([(i, a, "y") for i in range(5) for a in "ab"], "item int, annotator string, label string")
    assert stats.krippendorff_alpha(same).first().alpha == 1.0 and stats.cohen_kappa(same).first().kappa is None
    ci = spark.range(1).select(stats.wilson(F.lit(0), F.lit(0)).alias("a"), stats.wilson(F.lit(0), F.lit(0), clamp=False).alias("b")).first()
    assert ci.a.low is None and ci.b.low == 0.0
    assert evaluate.spearman(spark.createDataFrame([(1, 2)], "a int, b int"), "a", "b").first().rho == 0.0


def test_grounding_classes(spark):
    df = spark.createDataFrame([("Rome", "rome"), ("Rmoe", "Rome"), ("New", "New York"), ("Big Apple", "New York")], "m string, v string")
    assert [r[0] for r in df.select(evaluate.grounding_class(F.col("m"), F.col("v"))).collect()] == ["exact_ci", "edit_distance", "substring", "semantic"]


def test_first_sheet_of_the_workbook():
    """By the workbook's order, not by the parts' names; booleans and whole numbers are normalised."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda kind, v: f'<c r="A1"{kind}><v>{v}</v></c>'
    sheet = lambda cells: f'<worksheet xmlns="{main}"><sheetData><row>{cells}</row></sheetData></worksheet>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="b" r:id="r2"/><sheet name="a" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet(cell("", "1")))
        z.writestr("xl/worksheets/sheet2.xml", sheet(cell("", "7.0") + cell(' t="b"', "1").replace("A1", "B1") + cell(' t="str"', "8.0").replace("A1", "C1")))
    assert sources.xlsx_rows(data.getvalue()) == [["7", "TRUE", "8.0"]]


def test_places_in_skewed_groups(spark):
    """Rows of a hot group lie in many tasks and are numbered as by one."""
    rows = [("hot" if i % 10 else f"g{i % 7}", (i * 7919) % 5000) for i in range(5000)] + [(None, i) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, k int")
    got = sampling.placed(df, "g", "k").collect()
    want = {}
    for g in {g for g, _ in rows}:
        want |= {(g, k): i for i, k in enumerate(sorted(k for h, k in rows if h == g))}
    assert {(r.g, r.k): r._place for r in got} == want and len(got) == len(rows)


def test_searches_in_blocks(spark):
    """However values are dealt, the results are those of all values at once."""
    rng = random.Random(9)
    values = [("L", "p", "".join(rng.choice("abcd") for _ in range(6))) for _ in range(60)]
    asked = [(f"q{i}", "".join(rng.choice("abcd") for _ in range(6)), "L", "p") for i in range(9)]
    v, m = spark.createDataFrame(sorted(set(values)), "label string, prop string, value string"), spark.createDataFrame(asked, "qid string, phrase string, label string, prop string")
    rows = lambda d: sorted(map(tuple, d.select("qid", "value", "rank").collect()))
    assert rows(retrieval.lev_topk(v, m, 5, rows_per_block=7)) == rows(retrieval.lev_topk(v, m, 5))
    vectors = spark.createDataFrame([(f"v{i % 40}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)] + [("zero", [0.0] * 8), ("none", None)], "value string, embedding array<double>")
    queries = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(5)], "qid int, embedding array<double>")
    got = retrieval.vector_topk(vectors, queries, 6, rows_per_block=30)
    assert rows(got) == rows(retrieval.vector_topk(vectors, queries, 6)) and got.count() == 30


def test_difficulty_of_queries(spark):
    """Points for the longest path of any pattern, the hardest operation, and all predicates."""
    cases = {
        "MATCH (n:Nation) RETURN n.name": (0, 0, 0, "easy"),
        "MATCH (a)-[:X]->(b), (c)-[:X]->(d) RETURN a": (0, 0, 0, "easy"),  # two paths of one hop
        "MATCH (a)-->(b)<--(c) RETURN a": (1, 0, 0, "medium"),
        "MATCH (a)-[:R]->(b)-[:R]->(c)-[:R]->(d)-[:R]->(e) RETURN a": (2, 0, 0, "medium"),
        "MATCH (a)-[:X*1..3]->(b) RETURN b": (2, 0, 0, "medium"),
        "MATCH (n) WHERE EXISTS { (n)-[:X]->() } RETURN n": (0, 2, 0, "medium"),
        "MATCH (n) WHERE EXISTS { MATCH (n) WHERE EXISTS { (n)-[:X]->() } RETURN n } RETURN n": (0, 2, 1, "hard"),
        "MATCH (n {a: 1}) WHERE n.x = 1 AND n.y = 2 RETURN n": (0, 0, 2, "medium"),
        "MATCH (a) WHERE a.x = 1 WITH a WHERE a.y = 2 RETURN a": (0, 0, 1, "medium"),
        "MATCH (a) WHERE a.x = 1 AND a.y = 2 OR a.z = 3 RETURN a": (0, 0, 2, "medium"),
        "MATCH (a) RETURN coalesce(count(a), 0)": (0, 1, 0, "medium"),
        "MATCH (a) RETURN a.x, coalesce(count(a), 0)": (0, 2, 0, "medium"),
        "MATCH (a) RETURN a ORDER BY a.x LIMIT 10": (0, 1, 0, "medium"),
        "MATCH (a) RETURN a ORDER BY a.x LIMIT 1": (0, 2, 0, "medium"),
        "MATCH p = shortestPath((a)-[:X]-(b)) RETURN p": (0, 1, 0, "medium"),
        "MATCH (a)-[:X]->(b)-[:Y]->(c) RETURN a UNION MATCH (a) RETURN a": (1, 2, 0, "hard"),
        "MATCH (a) WHERE a.x = 'p AND q OR (r)-[*]->(s)' // WHERE AND\nRETURN a": (0, 0, 0, "easy"),
        "  ": None, None: None,
    }
    df = spark.createDataFrame([(i, q) for i, q in enumerate(cases)], "i int, q string").select("i", evaluate.difficulty(F.col("q")).alias("d"))
    got = {r.i: r.d and (r.d.reach, r.d.op, r.d["filter"], r.d.level) for r in df.collect()}
    assert got == dict(enumerate(cases.values()))


def test_entity_types_and_identifiers(spark):
    types = {
        "a@b.org": "email", "12:30": "time", "123-45-6789": "id", "2001-2-3": "date", "3/4": "date", "020 7946 0958": "id", "42": "id", "WN5": "id", "BL5 2RN": "id", "Area 51": "name", "Alice Smith": "name", "": "id", " ": "id", None: None,
    }
    df = spark.createDataFrame([(v,) for v in types], "v string").select("v", X.entity_type(F.col("v")).alias("t"))
    assert {r.v: r.t for r in df.collect()} == types
    names = {"JobPosting": "job_posting", "firstName": "first_name", "HTTPServer": "http_server", "tagline": "tagline"}
    df = spark.createDataFrame([(v,) for v in names], "v string").select("v", X.snake_case(F.col("v")).alias("t"))
    assert {r.v: r.t for r in df.collect()} == names
    kinds = {"ACTED_IN": "acted_in", ":`ACTED_IN`": "acted_in", "`:HAS WORKED  FOR!`": "has_worked_for"}
    df = spark.createDataFrame([(v,) for v in kinds], "v string").select("v", X.type_identifier(F.col("v")).alias("t"))
    assert {r.v: r.t for r in df.collect()} == kinds
    short = [("United States of America", "USoA", True), ("United States", "U.S.", True), ("anything", "ABC", True), ("Paris", "P", False), ("New York City", "new york", False), ("a b", "", False), ("x", "TOO LONG", False)]
    df = spark.createDataFrame(short, "n string, f string, w boolean").select(X.is_acronym(F.col("n"), F.col("f")).alias("g"), "w")
    assert all(r.g == r.w for r in df.collect())


def test_quota_sampler_converges_and_is_stable():
    targets = {"typo": 0.5, "partial": 0.3, "casing": 0.2}
    a, b = (sampling.QuotaSampler(targets, {"casing": 0.1}) for _ in range(2))
    taken = [a.take(set(targets)) for _ in range(200)]
    assert taken == [b.take(set(targets)) for _ in range(200)] and a.taken["casing"] <= 20 and abs(a.taken["typo"] - 110) <= 15
    assert a.take(set()) is None


def test_perturbations_are_seeded_and_keep_the_first_letter(spark):
    values = spark.createDataFrame([("L", "p", v) for v in ("green apple", "red apple", "Oslo", "a")], "label string, prop string, value string")
    one = {tuple(r) for r in augment.perturbed(values).collect()}
    assert one == {tuple(r) for r in augment.perturbed(values.repartition(3)).collect()}
    assert all(m[0] == v[0] for _, _, v, s, m in one if s == "typo") and ("L", "p", "green apple", "partial", "green") in one
    reasons = {(r.mention, r.strategy): r.reason for r in augment.validity(values.select("label", "prop", "value", F.lit("partial").alias("strategy"), F.lit("apple").alias("mention")), values).collect()}
    assert reasons == {("apple", "partial"): "not_unique"}
    nowhere = values.select(F.lit("X").alias("label"), "prop", "value", F.lit("casing").alias("strategy"), F.upper("value").alias("mention"))
    assert {r.reason for r in augment.validity(nowhere, values).collect()} == {"unchecked"}


def test_spans_prefer_the_longest():
    assert augment.extracted("green apple pie", ["green", "green apple", "apple pie"]) == [(0, 11, "green apple")]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [{"id": 1, "nl": "q", "cypher": "c"}, {"id": null, "question_id": 7, "question": "r"}]}')
    rows = sources.read_examples(spark, str(tmp_path / "a.json")).orderBy("qid").collect()
    assert [(r.qid, r.question, r.gold_cypher, r.graph) for r in rows] == [("1", "q", "c", None), ("7", "r", None, None)]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "1.jsonl").write_text('{"qid": 1}\n{"qid": 2\n')
    (tmp_path / "r" / "2.jsonl").write_text('{"qid": 3}\n')
    good, bad = sources.read_records(spark, str(tmp_path / "r"), "qid long")
    assert sorted(r.qid for r in good.collect()) == [1, 3] and [r[0] for r in bad.collect()] == ['{"qid": 2']
    (tmp_path / "c.csv").write_text('a,b\n"x\ny",\n" ",2\n')
    assert [tuple(r) for r in sources.read_csv(spark, str(tmp_path / "c.csv")).collect()] == [("x\ny", None), (None, "2")]
    (tmp_path / "t.tsv").write_text("a\tb\nc\tc\n")
    assert {tuple(r) for r in sources.read_alias_tsv(spark, str(tmp_path / "t.tsv")).collect()} == {("a", "b"), ("b", "a")}


def test_spreadsheets(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>An</t></r><r><t>n</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>age</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>30</v></c></row></sheetData></worksheet>')
    assert sources.xlsx_rows(data.getvalue()) == [["name", None, "age"], ["Ann", None, "30"]]
    (tmp_path / "x.xlsx").write_bytes(data.getvalue())
    table = sources.sheet_table(sources.read_xlsx(spark, str(tmp_path / "x.xlsx")), ["name", "none", "age"])
    assert [tuple(r) for r in table.collect()] == [("Ann", None, "30")]


def test_embedding_twice_adds_nothing(spark, tmp_path):
    values = spark.createDataFrame([("L", "p", f"v{i}") for i in range(7)], "label string, prop string, value string")
    done = spark.createDataFrame([], "label string, prop string, value string, embedding array<float>")
    path = str(tmp_path / "vectors")
    first = sources.embedded(values, done, lambda texts: [[float(len(t))] for t in texts], path, batch=3)
    assert first.count() == 7 and sources.embedded(values, first, lambda texts: [[0.0]] * len(texts), path).count() == 7


def test_markdown():
    assert evaluate.markdown([{"a": 1, "b": 0.5}, {"a": None, "b": 2.0}], ["a", "b"]).splitlines()[2] == "| 1   | 0.500 |"


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("easy", True), ("easy", None), ("hard", False)], "bucket string, ea boolean").write.json(folder)
    q = monitor.running_accuracy(monitor.record_stream(spark, folder, "bucket string, ea boolean")).writeStream.outputMode("complete").format("memory").queryName("acc").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.bucket, r.n, r.ea) for r in spark.table("acc").collect()} == {("easy", 2, 0.5), ("hard", 1, 0.0)}


def test_entry_points_agree(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 170
    assert entry.entry(spark).columns == ["n"]


@pytest.mark.parametrize("name", ["revenue_by_nation", "rrf_fusion", "krippendorff_alpha", "run_audit"])
def test_oracles(spark, name):
    import duckdb

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings labels conversations".split():
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    order = [[d[0] for d in want.description].index(c) for c in columns]
    rows = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in entry.queries()[name](spark, folder).collect()), key=repr)
    assert got == rows


def test_text_queries_take_every_row(spark, tmp_path):
    import re

    from lodestone.functions import text as X
    from lodestone.plans.suite import QUERIES

    texts = [" \n Two\t words\r\n", "Größe  Ünï", "plain", None, ""]
    spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([("abcd same",), ("wxyz other",), ("abdc same",)], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.turn: r.t for r in QUERIES["collapse_space"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else " ".join(t.lower().split()) for i, t in enumerate(texts)}
    got = {r.turn: r.words for r in QUERIES["tokenise"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else " ".join(w for w in re.findall(r"\w+", t.lower()) if w not in X.STOPWORDS) for i, t in enumerate(texts)}
    got = {(r.a, r.b): r.s for r in QUERIES["jaro_winkler"](spark, str(tmp_path)).collect()}
    jaro = (2 + 8 / 9) / 3
    assert got == {("abcd same", "abdc same"): round(jaro + 2 * 0.1 * (1 - jaro), 4)}


@pytest.mark.parametrize("name", ["fcav_topk", "cosine_topk", "node_profile", "rel_profile", "difficulty_bucket", "entity_typing", "leak_class", "error_class", "identifiers", "rater_files"])
def test_oracles_over_whole_tables(spark, name):
    test_oracles(spark, name)
