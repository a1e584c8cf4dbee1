"""Small inputs with known results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliant.functions import hooks
from foliant.functions import text as T
from foliant.operators import chunking as C
from foliant.operators import evaluation as E
from foliant.operators import graph as G
from foliant.operators import retrieval as R
from foliant.sources import ingest
from foliant.streaming import jobs as J


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("text", "needle", "found"), [("Parisian cafés", "paris", False), ("Sông Seine chảy qua Paris.", "sông Seine", True), ("", "x", False), ("a b", " ", False)])
def test_contains_phrase(spark, text, needle, found):
    assert value(spark, T.contains_phrase(F.lit(text), F.lit(needle))) is found


def test_cited_indices(spark):
    assert value(spark, T.cited_indices(F.lit("A [1]. B [2, 3]. C [4][9]."), F.lit(5))) == [1, 2, 3, 4]


def test_language_slip(spark):
    slip = lambda q, a: value(spark, T.is_language_slip(F.lit(q), F.lit(a)))
    assert slip("Ai là tác giả?", "这是答案")
    assert slip("Who is the author?", "这是答案")
    assert slip("Ai là tác giả?", "The author is unknown to the reader")
    assert not slip("Who is the author?", "The author is a person")


def test_parse_json_object(spark):
    show = lambda x: value(spark, F.variant_get(T.parse_json_object(F.lit(x)), "$.a", "int"))
    assert show('Here:\n```json\n{"a": 1}\n``` done') == 1
    assert show('{"a": 1') is None


def test_bm25_puts_the_rare_term_first(spark):
    docs = spark.createDataFrame([(1, "The cat sat on the mat why"), (2, "Dogs and cats why"), (3, "Fractal scaffolds grow")], "id long, text string")
    ask = lambda q: [r.id for r in R.bm25_search(spark.createDataFrame([(1, q)], "query long, text string"), docs, "id", 3).orderBy("rank").collect()]
    assert ask("why fractal scaffolds")[0] == 3
    assert ask("unrelated words") == []


def test_bm25_on_nothing(spark):
    none = spark.createDataFrame([], "id long, text string")
    assert R.bm25_search(spark.createDataFrame([(1, "a")], "query long, text string"), none, "id", 3).count() == 0


@pytest.mark.parametrize(("first", "second", "weight"), [("abc", "bca", 1.0), ("ab", "ba", 0.1)])
def test_rrf(spark, first, second, weight):
    ranked = lambda s: spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(s)], "query long, id string, rank int")
    assert R.rrf_fuse([(ranked(first), weight), (ranked(second), 1.0)], 3).where("rank = 1").first().id == "b"


def test_dense_topk_ties_and_scope(spark):
    rows = [(i, i % 2, [1.0, 0.0]) for i in range(6)] + [(9, 0, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id long, scope int, embedding array<float>")
    ask = spark.createDataFrame([(5, None, [1.0, 0.0]), (6, 1, [1.0, 0.0])], "query long, scope int, embedding array<float>")
    got = {(r.query, r.rank): r.id for r in R.dense_topk(ask, vectors, 2, block_rows=2).collect()}
    assert got == {(5, 1): 0, (5, 2): 1, (6, 1): 1, (6, 2): 3}


def pieces(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("p")).first().p


def test_chunks_of_paragraphs(spark):
    text = "First paragraph here.\n\nSecond paragraph here."
    one, two = (pieces(spark, C.structural(F.col("text"), n), text) for n in (1800, 30))
    assert [p.text for p in one] == [text]
    assert [p.text for p in two] == text.split("\n\n")
    assert [text[p.start :].startswith(p.text) for p in two] == [True, True]


def test_chunks_keep_long_sentences_whole(spark):
    text = "A" * 70 + " b. " + "C" * 10 + ". D."
    got = pieces(spark, C.pack_sentences(F.col("text"), F.lit(0), 30), text)
    assert "".join(p.text for p in got).replace(" ", "") == text.replace(" ", "")
    assert [text[p.start :][:5] for p in got] == [p.text[:5] for p in got]
    assert max(len(p.text) for p in got) <= 31


def test_chunk_overlap(spark):
    docs = spark.createDataFrame([(1, "First sentence is here. Second sentence is here. Third one.")], "doc_id long, text string")
    plain = C.explode(docs, C.pack_sentences(F.col("text"), F.lit(0), 40))
    first, second = (r.text for r in C.overlap(plain, 10).orderBy("chunk_index").limit(2).collect())
    assert second.startswith(first[-10:])


def test_semantic_cut(spark):
    text = "Cats purr. Cats sleep. Cats purr. Servers crash. Servers reboot. Servers crash."
    chunks = spark.createDataFrame([(1, 0, text, 0)], "doc_id long, chunk_index int, text string, start int")
    topic = F.when(F.contains("sentence", F.lit("Cats")), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    cut = lambda least: [r.text for r in C.semantic(chunks, topic, 0.45, least).orderBy("chunk_index").collect()]
    assert cut(0) == ["Cats purr. Cats sleep. Cats purr.", "Servers crash. Servers reboot. Servers crash."]
    assert cut(1000) == [text]


def test_windows_and_samples(spark):
    text = "\n\n".join("Paragraph with some more detail. " * 6 + "detail." for _ in range(30))
    got = pieces(spark, C.windows(F.col("text"), 3000), text)
    assert len(got) > 1
    assert max(map(len, got)) <= 3000
    assert got[0].endswith("detail.")
    items = lambda n: F.array(*(F.lit(f"w{i}") for i in range(n)))
    assert value(spark, C.sample(items(20), 4)) == ["w0", "w5", "w10", "w15"]
    assert value(spark, C.sample(items(3), 4)) == ["w0", "w1", "w2"]


def test_html(spark):
    html = "<html><body><style>x</style><h1>Chapter&#32;1</h1><p>Caf&#xe9; &amp; tea   time.</p><script>var a = '</p>';</script></body></html>"
    assert value(spark, ingest.html_to_text(F.lit(html))) == "Chapter 1\n\nCafé & tea time."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("a &lt;b&gt; &amp;lt; &quot;q&quot; &#38; &#x1F600; &#0; &#xD800; &unknown; & ;", "a <b> &lt; \"q\" & 😀 &#0; &#xD800; &unknown; & ;"),
        ("x<br>y<BR/>z<br />w", "x\ny\nz\nw"),
        ("<ul><li>one</li><li>two</li></ul><span>three</span>", "one\n\ntwo\n\nthree"),
        ("1 < 2 and 3 > 2", "1  2"[:2] + "2"),
        ("a \t b \n\n\n\n c\n d", "a b\n\nc\nd"),
        ("<BODY class='x'>in <style>p{}\n</style>it</body> out", "in it"),
        ("no tags", "no tags"),
        ("<script>never closed", "never closed"),
        ("", ""),
        (None, None),
    ],
)
def test_html_pieces(spark, html, text):
    assert value(spark, ingest.html_to_text(F.lit(html).cast("string"))) == text


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Plain téxt")
    (tmp_path / "b.html").write_text("<body><p>Hi</p></body>")
    (tmp_path / "c.bin").write_bytes(b"a\0b")
    (tmp_path / "d.txt").write_bytes(b"caf\xe9")
    (tmp_path / "f.PDF").write_bytes(b"%PDF-1.7")
    (tmp_path / "g.htm").write_text("<body><script>x</script></body>")
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.status, r.why) for r in ingest.read_files(spark, str(tmp_path)).collect()}
    assert got == {
        "a.txt": ("Plain téxt", "READY", None), "b.html": ("Hi", "READY", None), "c.bin": (None, "FAILED", "binary"), "d.txt": (None, "FAILED", "not UTF-8"),
        "f.PDF": (None, "FAILED", "no decoder for this kind"), "g.htm": ("", "FAILED", "no text"),
    }
    empty = ingest.decode_files(spark.createDataFrame([("x.txt", bytearray()), ("y.html", None)], "path string, content binary"))
    assert {(r.status, r.why) for r in empty.collect()} == {("FAILED", "empty")}
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.json").write_text('[{"a": 1}, {"a": 2}]')
    assert ingest.read_json_dataset(spark, str(tmp_path / "d/x.json"), "a int").count() == 2


def test_entity_resolve(spark):
    rows = spark.createDataFrame([(1, "Robert Downey Jr.", "person", "actor"), (2, "robert downey jr.", "", ""), (3, "Zodiac", None, "film")], "seq long, name string, type string, description string")
    got = {r.key: (r.name, r.type, r.description) for r in G.resolve(rows, "name", "seq", F.col("type"), F.col("description")).collect()}
    assert got == {"robert downey jr.": ("Robert Downey Jr.", "person", "actor"), "zodiac": ("Zodiac", "concept", "film")}


def test_components_and_bfs(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "src long, dst long")
    got = {r.node: r.component for r in G.components(chain).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert {r.node: r.depth for r in G.breadth_first(chain, spark.createDataFrame([(5,)], "node long"), 2).collect()} == {5: 0, 4: 1, 6: 1, 3: 2, 7: 2}


def test_stale_and_backoff(spark):
    rows = spark.sql("select 1 id, 'RUNNING' status, timestamp'2024-01-01 00:00:00' seen, 1 n union all select 2, 'RUNNING', timestamp'2024-01-01 00:09:00', 1 union all select 3, 'RUNNING', timestamp'2024-01-01 00:00:00', 3")
    now = F.lit("2024-01-01 00:10:00").cast("timestamp")
    assert {r.id: r.status for r in J.stale(rows, "id", now, "n").collect()} == {1: "PENDING", 2: "RUNNING", 3: "DEAD"}
    assert [value(spark, J.backoff_seconds(F.lit(n))) for n in (1, 2, 3, 9)] == [20, 40, 80, 300]


def test_mcnemar(spark):
    p = lambda a, b: value(spark, E.mcnemar_p(F.lit(a), F.lit(b)))
    assert p(0, 0) == 1
    assert abs(p(1, 8) - 0.0390625) < 1e-9
    assert p(3, 3) == 1


def test_independent_first(spark):
    items = spark.range(1, 8).withColumnRenamed("id", "item")
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (6, 7)], "a long, b long")
    assert {r.item for r in E.independent_first(items, links).collect()} == {1, 3, 5, 6}


def test_llm_map_retries_and_reports(spark):
    def model(text):
        if text == "bad":
            raise ValueError("no such model")
        return text.upper()

    rows = spark.createDataFrame([("good",), ("bad",), (None,)], "prompt string")
    got = {r.prompt: (r.answer, r.error) for r in hooks.llm_map(rows, "prompt", model).collect()}
    assert got == {"good": ("GOOD", None), "bad": (None, "no such model"), None: ("", None)}


def test_generation_options_waits_and_lasting_failures(spark):
    def model(text, temperature=1.0):
        if text == "busy" and not hasattr(model, "seen"):
            model.seen = True
            raise hooks.GenerationError("slow down", status=429, retry_after=0.01)
        if text == "refused":
            raise hooks.GenerationError("at row 500 of the table", status=400)
        if text == "patient":
            raise hooks.GenerationError("come back tomorrow", status=429, retry_after=86_400)
        return f"{text} at {temperature}"

    rows = spark.createDataFrame([("busy",), ("refused",), ("patient",), ("plain",)], "prompt string").coalesce(1)
    got = {r.prompt: (r.answer, r.error) for r in hooks.llm_map(rows, "prompt", model, wait=0.0, options={"temperature": 0.2}).collect()}
    assert got == {"busy": ("busy at 0.2", None), "refused": (None, "at row 500 of the table"), "patient": (None, "come back tomorrow"), "plain": ("plain at 0.2", None)}
    assert hooks._pause(ValueError("500 rows are too many"), 1.0, 60.0) is None
    assert hooks._pause(OSError("HTTP 503"), 1.0, 60.0) == 1.0 and hooks._pause(TimeoutError(), 2.0, 60.0) == 2.0


def test_words_end_at_letters_beyond_ascii_as_in_sql(spark):
    """A letter beyond ASCII is no part of a word for \\b in the SQL, so "çan" holds "an" and "üin" holds "in"."""
    rows = spark.createDataFrame([(0, "que çan"), (1, "Üin."), (2, "pan ani"), (3, "an_ _an an1"), (4, "an"), (5, "")], "id int, x string")
    counted = {r.id: r.n for r in rows.select("id", T.count_words(F.col("x"), T.ENGLISH_WORDS).alias("n")).collect()}
    assert counted == {0: 1, 1: 1, 2: 0, 3: 0, 4: 1, 5: 0}
    assert spark.createDataFrame([("éunable to",)], "x string").select(T.abstained(F.col("x")).alias("a")).first().a


def test_fixed_windows_of_a_long_text(spark):
    """A window costs its block of the text; when each cost all text before it, this took many minutes."""
    import random
    import time

    rng = random.Random(3)
    text = "".join(rng.choice("abcdé  .\n") if rng.random() < 0.1 else "x" for _ in range(1_000_000)).strip()
    want, at = [], 0
    while at < len(text):
        window = text[at : at + 512]
        stop = max(window.rfind("."), window.rfind("\n"))
        end = at + stop + 1 if at + 512 < len(text) and stop > 256 else at + 512
        if text[at:end].strip():
            want.append((text[at:end].strip(), at))
        at = end - 50
    began = time.monotonic()
    rows = C.explode(spark.createDataFrame([(1, f" {text}\n"), (2, ""), (3, None)], "doc_id int, text string"), C.fixed(F.col("text"))).collect()
    assert [(r.text, r.start) for r in sorted(rows, key=lambda r: r.chunk_index)] == want
    assert time.monotonic() - began < 60
