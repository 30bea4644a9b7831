"""The text operators on DataFrames: nulls, empty tables, repeated rows, long texts and columns with clashing names."""

import os

import pytest
from pyspark.sql import functions as F

from archspark.llm import bpe, docpairs, leakage, pairs, provenance, queries, reading, secrets, splitting, syntax

VOCABULARY = f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
LONG = "word " * 60_000


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files")
def test_encode(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Hello world"), (4, LONG)], "doc_id bigint, text string").withColumn("ids", F.lit("clash")).withColumn("id", F.lit(0))
    got = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert got[1] == [] == got[2] and got[3] == [15496, 995] and len(got[4]) == 60_001
    assert bpe.encode(df.limit(0)).count() == 0 and bpe.encode(df).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]


def test_leaks(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    items = spark.createDataFrame([(1, passage), (2, passage), (3, None), (4, "too short"), (None, passage)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " + passage.upper().replace(" ", ", ") + " y"), (3, "x " + passage), (4, "one two three four five six seven eight nine ten eleven"), (5, LONG + passage)], "doc_id bigint, text string").withColumn("item_id", F.lit(9))
    assert rows(leakage.leaks(docs, items)) == [(3, 1), (3, 2), (5, 1), (5, 2)]
    assert leakage.leaks(docs.limit(0), items).count() == 0 and leakage.leaks(docs, items.limit(0)).count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEM_BLOCK", 2)
    items = spark.createDataFrame([(k, " ".join(f"i{k}w{j}" for j in range(15))) for k in range(5)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, " ".join(r["text"] for r in items.collect()))], "doc_id bigint, text string")
    assert rows(leakage.leaks(docs, items)) == [(1, k) for k in range(5)]


def test_split(spark):
    text = "def f():\n" + "    x = 1\n" * 2000
    df = spark.createDataFrame([(1, None, 5), (2, "short", 5), (3, text, 100), (3, text, 100), (None, text, 0), (4, text, None), (5, "", 0)], "chunk_no bigint, text string, byte_start bigint").withColumn("cut", F.lit(1))
    got = splitting.split(df).collect()
    assert {r.chunk_no for r in got} == {3, 4} and {r.cut for r in got} == {"natural"}
    mine = sorted((r for r in got if r.chunk_no == 3), key=lambda r: r.piece_no)
    assert mine[0].byte_start == 100 and mine[-1].byte_end == 100 + len(text) and all(len(r.text.encode()) <= 8000 for r in mine)
    assert "".join(r.text[r.own_start - r.byte_start :] for r in mine) == text and all(r.byte_start is None for r in got if r.chunk_no == 4)
    assert {r.chunk_no for r in splitting.split(df, only_oversized=False).collect()} == {2, 3, 4, 5}
    assert splitting.split(df.limit(0)).count() == 0


def test_faults_and_rates(spark):
    df = spark.createDataFrame(
        [(1, "r", "r/a.py", "x = ("), (1, "r", "r/a.py", "x = ("), (2, "r", "r/b.py", None), (3, "r", "r/c.py", ""), (4, "r", "r/d.txt", "("), (5, None, "r/e.hpp", "int f() {"), (6, "r", None, "("), (7, "r", "r/g.py", "x = 1\n" * 50_000)],
        "file_id bigint, repo string, path string, content string",
    ).withColumn("language", F.lit("clash"))
    assert {(r.file_id, r.language, r.cause) for r in syntax.faults(df).collect()} == {(1, "python", "truncated"), (5, "cpp", "truncated")}
    stats = spark.createDataFrame([("r", 3), ("r", None)], "repo string, files_failed bigint")
    got = {(r.repo, r.language): (r.files, r.failed, r.recorded_failed) for r in syntax.rates(df, stats).collect()}
    assert got == {("r", "python"): (3, 1, 3), (None, "cpp"): (1, 1, None)}
    assert syntax.faults(df.limit(0)).count() == 0


def test_doc_pairs(spark):
    text = 'def f(a):\n    """Adds one to every entry."""\n    return a\n'
    df = spark.createDataFrame([(1, "function", text, None), (1, "function", text, None), (2, "class", text, "f"), (3, "function", None, "f"), (None, "function", text, "f"), (4, None, text, "f"), (5, "function", text + "    x = 1\n" * 20_000, "K.f")], "chunk_no bigint, kind string, text string, qualified_name string").withColumn("code", F.lit(1))
    assert {(r.chunk_no, r.name, r.description) for r in docpairs.pairs(df).collect()} == {(1, "f", "Adds one to every entry."), (5, "K.f", "Adds one to every entry.")}
    assert docpairs.pairs(df.limit(0)).count() == 0 and docpairs.pairs(df, with_texts=False).columns == ["chunk_no"]


def test_secrets(spark):
    df = spark.createDataFrame([(1, 'x = "ghp_' + "a1B2" * 9 + '"\n', None), (1, 'x = "ghp_' + "a1B2" * 9 + '"\n', None), (2, None, "a.py"), (None, "password = 'abcDEF123456'", "a.py"), (3, "", "a.py"), (4, LONG + '\ntoken = "ghp_' + "c3D4" * 9 + '"\n', "a.py")], "id bigint, text string, path string").withColumn("row_id", F.lit(1)).withColumn("secret", F.lit(1))
    model = secrets.learn([(df, "id", "text", "path")], 100)
    assert rows(secrets.find(df, model, id_column="id", text_column="text", path_column="path")) == [(1, "ghp_" + "a1B2" * 9), (4, "ghp_" + "c3D4" * 9)]
    masked = {r.row_id: r.text for r in secrets.redacted(df, model, id_column="id", text_column="text").collect()}
    assert masked[1] == 'x = "' + "*" * 40 + '"\n' and masked[2] is None and masked[3] == ""
    assert secrets.find(df.limit(0), secrets.train([]), id_column="id", text_column="text").count() == 0


def test_secrets_are_learned_from_every_text(spark):
    """As many texts as no sample would take: the model of the table is that of all its texts, and rows repeated, rows
    without id or text and the number of partitions change nothing."""
    texts = [(k, f'a_{k} = "word{k % 7}ing_{k}"\npassword = "q{k * 7919:x}Zb6W{k}uK"\nzq{"xyw"[k % 3] * 3}s\n', f"src/f{k % 3}.py") for k in range(4300)]
    whole = secrets.train([(t, p) for _, t, p in texts])
    df = spark.createDataFrame([*texts, *texts[:500], (None, 'token = "zzzzqq11qqzz22"', "a.py"), (9999, None, "a.py")], "id bigint, text string, path string")
    for table in (df.repartition(5), df.coalesce(1)):
        model = secrets.learn([(table, "id", "text", "path")])
        for name in ("mean", "deviation", "weights", "slope", "shift"):
            assert getattr(model, name) == pytest.approx(getattr(whole, name), rel=1e-6, abs=1e-6), name
        assert model.markov.logp == pytest.approx(whole.markov.logp)
    read = secrets.gather([("t", df, "id", "text", "path")], with_texts=True)
    options = {"id_column": "id", "text_column": "text", "path_column": "path"}
    assert rows(secrets.found_in(read, model).select("row_id", "secret")) == rows(secrets.find(df, model, **options))
    assert rows(secrets.redacted_in(read, model).select("row_id", "text")) == rows(secrets.redacted(df, model, **options).distinct())


def test_provenance(spark):
    body, other = (open(m.__file__, encoding="utf-8").read() for m in (splitting, leakage))
    df = spark.createDataFrame(
        [(1, "a", "a/x.py", body), (2, "b", "b/y.py", "# note\n" + body), (3, "a", "a/z.py", other), (3, "a", "a/z.py", other), (4, "c", "c/w.py", None), (5, "c", "c/v.py", ""), (6, None, None, "x = 1\n"), (7, "c", "c/vendor/v.py", "x = 2\n"), (8, "a", "a/q.py", other + "\nz = 1\n")],
        "file_id bigint, repo string, path string, content string",
    ).withColumn("cause", F.lit(1)).withColumn("h", F.lit(1))
    assert {(r.file_id, r.cause) for r in provenance.files_to_remove(df).collect()} == {(1, "vendored"), (2, "vendored"), (7, "vendored")}
    assert provenance.files_to_remove(df.limit(0)).count() == 0


def test_pair_defects(spark):
    schema = "id bigint, request string, prompt string, response string, error string"
    df = spark.createDataFrame([(1, "Why is it so?", "p", None, None), (1, "Why is it so?", "p", None, None), (2, None, None, None, "e"), (3, "Why is it so now?", None, "Why is it so now?", None), (None, "q", "p", "", None), (4, None, None, LONG + ".", None)], schema).withColumn("defect", F.lit(1))
    assert rows(pairs.defects(df, pairs.train(pairs.sample(df)))) == [(1, "empty"), (3, "copy")]
    assert pairs.defects(df.limit(0), pairs.train([])).count() == 0


def odd_pairs(n):
    """Pairs of which every tenth ends in a sign of its own, so that a model that did not see it takes it for a cut."""
    words = "the cache of a module is read before its graph and the parser moves to another layer that holds every edge".split()
    german = "Die Klasse wird nicht mit der Datei geladen und die Tests sind danach ohne weitere Arbeit wieder grün."
    out = []
    for k in range(n):
        said = " ".join(words[(k * 7 + j * j) % len(words)] for j in range(12))
        end = chr(0x2200 + k // 10) if k % 10 == 0 and k < 2000 else "." if k % 31 else ""
        out.append((k, "How does the parser of the module read the graph?", None, german if k % 97 == 3 else said + end + ("\n```\nx = 1" if k % 89 == 1 else ""), None))
    return [*out, (n, "Why is it so now?", None, "Why is it so now?", None), (n + 1, "q", "p", None, None), (n + 2, "q", "p", None, "e"), (n + 3, None, None, "\u2200 is all of them.", "e")]


def test_pair_models_are_learned_from_every_pair(spark, tmp_path):
    """More pairs than a sample would take; rows repeated, without an id or a response and the layout change nothing."""
    given = odd_pairs(6000)
    model = pairs.train([(q, r) for _, q, _, r, _ in given if r is not None])
    want = sorted(((k, d) for k, *texts in given if (d := model.defect(*texts))), key=str)
    assert {d for _, d in want} == {"empty", "copy", "language", "truncated"}
    df = spark.createDataFrame([*given, *given[:700], (None, "q", "p", "The rest is \u2201", None)], "id bigint, request string, prompt string, response string, error string").withColumn("defect", F.lit(1))
    for k, table in enumerate((df.repartition(7), df.coalesce(1))):
        table.write.parquet(f"{tmp_path}/{k}/requests.parquet")
        assert rows(queries.p6_found(spark, f"{tmp_path}/{k}")) == want
    assert pairs.found(df.limit(0)).count() == 0


def test_pair_counts_do_not_depend_on_when_they_are_handed_on(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*odd_pairs(300))], ["id", "request", "prompt", "response", "error"])

    def counted():
        total = {}
        for r in (r for out in pairs._study(iter([batch])) for r in out.to_pylist() if r["ends"] is not None):
            key = tuple(r[k] for k in ("open", "tail", "a", "b", "c", "kind"))
            total[key] = tuple(map(sum, zip(total.get(key, (0, 0)), (r["ends"], r["inners"]))))
        return total

    whole = counted()
    monkeypatch.setattr(pairs, "GRAMS_AT_ONCE", 10)
    assert counted() == whole and len(whole) > 300


def test_grades(spark):
    easy = "The tree stops. It needs one page now. The dog eats the food. " * 12
    hard = "The heterogeneous encapsulation of the architecture fundamentally presupposes the interoperability of the configuration because the probabilistic serialisation delineates its idiosyncratic responsibility, although the parameterisation exacerbates the decomposition. " * 6
    french = "Le cycle est dans le module et la classe ne sait pas que les fichiers sont trop grands pour elle. " * 10
    docs = spark.createDataFrame([(1, easy), (1, easy), (2, hard), (3, None), (4, "Too short."), (5, french), (6, ""), (7, easy * 300), (None, easy)], "doc_id bigint, text string").withColumn("grade", F.lit(9))
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 5), (2, None), (99, 3), (None, 2), (1, 77)], "doc_id bigint, grade int")
    assert rows(reading.grades(docs, labels)) == [(1, 1), (2, 5), (7, 1)]
    assert reading.grades(docs, labels.limit(0)).count() == 0 and reading.grades(docs.limit(0), labels).count() == 0


def test_registered(spark):
    names = set(queries.QUERIES)
    assert {f"p{n}_found" for n in (1, 2, 3, 5, 6, 7, 9, 10)} | {"p8_ids"} <= names and set(queries.SQL) <= names


def test_sample_is_bounded_and_stable(spark):
    from archspark.llm.text import least_by_hash

    df = spark.range(20_000).withColumn("x", F.lit(1))
    everything = {r.id for r in least_by_hash(df, "id", 20_000).collect()}
    assert len(everything) == 20_000
    for rows in (0, 1, 100, 13_000, 13_400, 19_999):
        a = {r.id for r in least_by_hash(df, "id", rows).collect()}
        b = {r.id for r in least_by_hash(df.repartition(7).unionByName(df), "id", rows).collect()}
        assert len(a) == rows and a == b if rows else a == b == set()
    assert least_by_hash(df.limit(0), "id", 5).count() == 0
