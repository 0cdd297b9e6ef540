"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import random

from pyspark.sql import functions as F

from hydroframe.llm import ann, chat, decontaminate, langid, linededup, mixing, neardup, suffixdedup, toxicity, urlfilter
from hydroframe.llm.store import Store


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_near_duplicates(odd_docs, no_docs):
    df, rows = odd_docs
    out = rows_of(neardup.near_duplicates(df))
    assert len(out) == len(rows)
    classes = {r["doc_id"]: r["class_id"] for r in out if r["doc_id"] is not None}
    assert classes[6] == 5 and classes[5] == 5 and classes[7] == 7 and classes[1] == 1 and classes[2] == 2
    kept = neardup.deduplicate(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 1
    assert neardup.near_duplicates(no_docs).count() == 0


def test_line_dedup(odd_docs, no_docs):
    df, rows = odd_docs
    out = rows_of(linededup.line_report(df))
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert by[6]["n_removed"] == 1 and by[6]["class_id"] == 5 and by[7]["n_removed"] == 0 and by[3]["n_lines"] == 3
    kept = linededup.dedup_lines(df)
    assert kept.columns == df.columns
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    assert 6 not in left and {1, 2, 3, 4, 5, 7, 8, 9, -3, None} <= left
    assert linededup.line_report(no_docs).count() == 0 and linededup.dedup_lines(no_docs).count() == 0


def test_suffix_dedup(odd_docs, no_docs):
    df, rows = odd_docs
    out = rows_of(suffixdedup.suffix_dedup(df))
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert by[6]["n_removed"] == by[6]["n_bytes"] == len(rows[6][1].encode()) and by[5]["n_removed"] == 0
    assert by[9]["n_removed"] == 4999 and by[7]["n_removed"] == 0
    assert by[1]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert suffixdedup.suffix_dedup(no_docs).count() == 0


def test_decontamination(odd_docs, no_docs, bench):
    df, rows = odd_docs
    out = {r["doc_id"]: r for r in rows_of(decontaminate.digest(decontaminate.contamination(df, bench)))}
    assert out[7]["n_hit"] == 10 and out[7]["n_items"] == 1 and out[7]["items_sha256"] == hashlib.sha256(b"1").hexdigest()
    assert out[1]["n_words"] == 0 and not out[1]["contaminated"]
    clean = decontaminate.decontaminate(df, bench)
    assert clean.columns == df.columns and clean.count() == len(rows) - 2
    cut = decontaminate.decontaminate(df, bench, mode="spans").where("doc_id = 7").first()
    assert cut.text == ""  # touching spans go as one
    empty = bench.limit(0)
    assert decontaminate.decontaminate(df, empty).count() == len(rows) and decontaminate.contamination(no_docs, bench).count() == 0


def test_mixing(odd_docs, no_docs):
    df, rows = odd_docs
    out = mixing.mix(df, num=1, den=1)
    assert {"domain", "n_tokens", "copies"} <= set(out.columns)
    assert all(r["copies"] >= 1 and r["n_tokens"] > 0 for r in rows_of(out))
    assert mixing.mix(df, num=100, den=1).count() == sum(1 for r in rows if r[1] and r[1].strip())
    assert mixing.mix(no_docs).count() == 0


def test_language(odd_docs, no_docs):
    df, rows = odd_docs
    model = langid.train(df)
    out = rows_of(langid.identify(df, model))
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == by[4]["lang_pred"] == "und" and by[5]["lang_pred"] in ("en", "fr")
    assert all(0 <= r["score"] <= 1 for r in out)
    assert langid.train(no_docs) is None and {r["lang_pred"] for r in rows_of(langid.identify(df, None))} == {"und"}


def test_toxicity(spark, odd_docs, no_docs):
    df, rows = odd_docs
    labels = spark.createDataFrame([(7, 1, 1), (5, 0, 0), (5, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score(df, toxicity.learn(df, labels), "__s")
    assert out.count() == len(rows) and all(0 <= r["__s"] <= 1 for r in rows_of(out))
    assert toxicity.learn(no_docs, labels.limit(0)) == toxicity.Grammar()
    grammar = toxicity.Grammar(frozenset({"idiot"}), frozenset(), {"I": 5.0}, -3.0)
    assert toxicity.score(no_docs, grammar).count() == 0
    by = {r["doc_id"]: r["score"] for r in rows_of(toxicity.score(df.drop("score"), grammar))}
    assert by[1] == by[2] == by[3] and by[1] < 0.06
    words = spark.createDataFrame([("Maul", "threat"), ("dir", "target"), (None, "threat"), ("kaum", "negation")], "word string, kind string")
    assert toxicity.Lexicon.read(words) == toxicity.Lexicon(frozenset({"maul"}), frozenset({"dir"}), frozenset({"kaum"}), frozenset())


def test_neighbours(spark):
    v = [1.0] + [0.0] * 7
    rows = [(0, v), (1, v), (2, [0.5] * 8), (2, [0.5] * 8), (3, None), (4, [0.0] * 8), (5, [float("nan")] * 8), (6, [None] + v[1:]), (7, v[:4]), (None, v), (8, [-1.0] * 8)]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<float>, label int").withColumn("score", F.lit(1)).withColumn("id", F.lit(9))
    out = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows_of(ann.neighbours(df, df.where("vec_id % 20 = 0")))]
    assert sorted(out) == [(0, 1, 1, 1.0), (0, 2, 2, 0.5), (0, 3, 8, -1.0)]
    assert ann.neighbours(df.limit(0), df).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Net/x?y#z", "x://h#f", "http://b.example.com/de/1", "http://example.net/en/2", "http://q.org/fr/", "http://ok.com/Casino!", "http://ok.com/xcasino", "http://ok.com/?promo=1&bonus=2", "http://ok.com/?promo=1&promo=2"]
    df = spark.createDataFrame([(k, u, "v") for k, u in enumerate(urls)], "page_id long, url string, verdict string").withColumn("host", F.lit(1)).withColumn("terms", F.lit(2))
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows_of(urlfilter.judge(df))}
    assert out[0] == out[1] == out[2] == out[3] == ("", "", None, "allow")
    assert out[4] == ("a.net", "/x", "net/", "block") and out[5] == ("h", "", None, "allow")
    assert out[6][2:] == ("example.com/de/", "block") and out[7][2:] == ("example.net/en/", "allow") and out[8][2:] == ("org/fr/", "allow")
    assert out[9][3] == "block" and out[10][3] == "allow" and out[11][3] == "block" and out[12][3] == "allow"
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_url_vocabulary(spark):
    long = "http://a.com/" + "x" * 200_000 + "/casino"
    urls = ["http://a.com/viagra", "http://a.com/viagra/viagra", "http://a.com/viagra?bonus", "http://a.com/poker", long, long, "http://a.com/Übung/casino/ö"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert [r["verdict"] for r in sorted(rows_of(urlfilter.judge(df)), key=lambda r: r["page_id"])] == ["allow", "allow", "block", "allow", "block", "block", "block"]
    table = spark.createDataFrame([("Alpha", None), ("beta", 5), ("gamma", 1), ("gamma", None), (None, 3), ("delta", 1), ("eps", 1)], "term string, weight int")
    own = urlfilter.Vocabulary.read(table)
    assert own.strict == ("alpha", "gamma") and own.soft == {"beta": 5, "delta": 1, "eps": 1}
    got = urlfilter.judge(spark.createDataFrame([(1, "http://x/gamma"), (2, "http://x/beta"), (3, "http://x/delta-eps"), (4, "http://x/casino")], "page_id long, url string"), vocabulary=own)
    assert {r["page_id"]: r["verdict"] for r in rows_of(got)} == {1: "block", 2: "allow", 3: "block", 4: "allow"}
    # Of rules of equal length the one with the longer host decides, then a blocking one.
    rules = [("net", "/abcdefgh", "block"), ("example.net", "/", "allow"), ("x.org", "/", "allow"), ("x.org", "/", "block")]
    got = urlfilter.judge(spark.createDataFrame([(1, "http://example.net/abcdefgh"), (2, "http://x.org/")], "page_id long, url string"), rules, urlfilter.Vocabulary((), {}))
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in rows_of(got)} == {1: ("example.net/", "allow"), 2: ("x.org/", "block")}


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (1, 1, "bot", "yo"), (None, 0, "user", "x"), (2, 0, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1)).withColumn("perspective", F.lit("p"))
    seg = chat.rotate(df, chunk=1)
    whole = {(r["conv_id"], r["perspective"]): r for r in rows_of(chat.dialogues(seg))}
    assert set(whole) == {(1, "user"), (1, "bot"), (1, "unknown"), (None, "user")}
    text = whole[1, "user"]["dialogue"]
    assert text == "<|im_start|>user name=unknown\n<|im_end|>\n" + 2 * "<|im_start|>assistant\nhi<|im_end|>\n" + "<|im_start|>user name=bot\nyo<|im_end|>\n"
    assert [text[s.train_start : s.train_end] for s in whole[1, "user"]["train_spans"]] == ["hi<|im_end|>"] * 2
    assert chat.rotate(df.limit(0)).count() == 0


def test_chat_long_texts_and_equal_turns(spark):
    rows = [(1, 5, "user", "x" * 100_000), (1, 5, "bot", "")] + [(1, 5, "user", f"t{k:03}") for k in range(150)] + [(1, 5, "bot", "same")] * 100
    seg = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chunk=2).collect()
    order = sorted(rows, key=lambda r: (r[1], r[2], r[3]))
    for who in ("user", "bot"):
        mine = sorted((r for r in seg if r.perspective == who), key=lambda r: r.pos)
        want = ["<|im_start|>" + ("assistant" if r[2] == who else f"user name={r[2]}") + f"\n{r[3]}<|im_end|>\n" for r in order]
        assert [r.segment for r in mine] == want
        ends = [sum(map(len, want[: k + 1])) for k in range(len(want))]
        assert [r.seg_end for r in mine] == ends and [r.seg_start for r in mine] == [0, *ends[:-1]]


def test_decontamination_in_passes(spark, odd_docs, bench):
    df, rows = odd_docs
    more = [(7, "another line here and there", "en", "src1", 3), (None, "another line here", "en", "src1", 3), (None, "one two three four five six seven eight", "en", "src1", 3)]
    df = df.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long").select("doc_id", "text"))

    def judged(**kw):
        return sorted(map(repr, decontaminate.digest(decontaminate.contamination(df, bench, **kw)).collect()))

    whole = judged()
    assert len(list(decontaminate._pieces(bench, 10, 1))) > 1 and len(whole) == len(rows) + len(more)
    assert judged(max_windows=1) == whole
    assert sorted(r.n_hit for r in decontaminate.digest(decontaminate.contamination(df, bench, max_windows=1)).where("contaminated").collect()) == [3, 3, 7, 10, 10]


def test_suffix_dedup_repeated_rows(spark):
    rng = random.Random(11)
    prose = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    rows = []
    for k in range(10):
        passage, repeated, begin = prose(300), prose(400), prose(400)
        rows += [(10 * k, prose(300) + passage + prose(300))]
        rows += 2 * [(10 * k + 1, prose(250) + passage + repeated)]  # the same row twice
        rows += [(10 * k + 2, repeated[50:350] + prose(300))]
        rows += [(10 * k + 3, begin + prose(200)), (10 * k + 3, begin + prose(150))]  # one id, two texts
    first = {}
    for i, t in rows:
        for p in range(len(t) - 99):
            first[t[p : p + 100]] = min(first.get(t[p : p + 100], (i, p)), (i, p))
    want = []
    for i, t in rows:
        gone = {q for j, x in rows if j == i for p in range(len(x) - 99) if first[x[p : p + 100]] != (i, p) for q in range(p, p + 100)}
        want.append((i, len(t), len([q for q in gone if q < len(t)])))
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in suffixdedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(want) and all(300 <= n < 310 for i, _, n in want if i % 10 == 1) and not any(n for i, _, n in want if i % 10 == 3)


def test_near_duplicates_without_id(spark):
    words = [f"w{k}" for k in range(200)]
    near = lambda n: " ".join([*words[:-n], *(f"z{k}" for k in range(n))] if n else words)
    begun = " ".join([*(f"y{k}" for k in range(16)), *words[16:]])
    rows = [(1, near(16)), (None, near(0)), (2, begun), (3, "quite another text with words of its own")]  # 1 and 2 meet only through the null row
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.class_id, r.n_links) for r in out) == [("1", 1, 1), ("2", 1, 1), ("3", 3, 0), ("None", 1, 2)]


def test_hashes_do_not_collide(spark):
    """Texts that differ in every byte, and words that agree in 44 bits of a weak hash, stay apart."""
    flip = [0]
    while len(flip) < 1024:
        flip += [1 - x for x in flip]
    one, other = "".join("ab"[x] for x in flip), "".join("ba"[x] for x in flip)
    rows = [(1, one), (2, other), (3, "yafgatev"), (4, "jumsskxj"), (5, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_removed) for r in linededup.line_report(df).collect()} == {1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (4, 0), 5: (1, 1)}
    assert {r.doc_id for r in linededup.dedup_lines(df).collect()} == {1, 2, 3, 4}
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_one_id_with_several_texts(spark):
    rng = random.Random(12)
    x, y, z = ("".join(rng.choices("abcdefghij", k=300)) for _ in range(3))
    rows = [(1, x), (5, x + y), (5, z + y + "tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffixdedup.suffix_dedup(df).collect())
    assert out == [(1, 300, 0), (5, 600, 300), (5, 604, 0)]  # y stands at one place of id 5
    a, b, c = ("\n".join(f"{k} line {n} has words of its own {k}{n}" for n in range(3)) for k in "abc")
    df = spark.createDataFrame([(1, a), (5, a + "\n" + b), (5, c)], "doc_id long, text string")
    assert sorted(r.text for r in linededup.dedup_lines(df).collect()) == sorted([a, b, c])
    assert sorted((r.doc_id, r.n_lines, r.n_removed) for r in linededup.line_report(df).collect()) == [(1, 3, 0), (5, 3, 0), (5, 6, 3)]


def test_pipeline_on_odd_tables(spark, tmp_path, odd_docs, no_docs, bench):
    import corpus_pipeline

    df, rows = odd_docs
    labels = spark.createDataFrame([(7, 1, 0), (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", df), ("empty", no_docs)):
        for table, t in (("documents", docs), ("labels", labels if name == "odd" else labels.limit(0)), ("benchmark", bench if name == "odd" else bench.limit(0))):
            t.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        at = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for stage, run in corpus_pipeline.STAGES[:-1]:
            out = run(spark, at, f"{tmp_path}/{name}")
            assert out.columns == docs.columns, stage
            kept = Store(spark).write(out)
            assert kept.count() == {"empty": 0}.get(name, kept.count()) and kept.subtract(at).where("text is null or text not like '%one two%'").count() == 0, stage
            at = kept
        left = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        ids = {r["doc_id"] for r in rows_of(left)}
        assert {"domain", "n_tokens", "copies"} <= set(left.columns)
        # 6 repeats 5, 7 and one row without an id hold benchmark passages, 1 to 3 have no token.
        assert ids <= {4, 5, 8, 9, -3, None} and (name == "empty") == (not ids)
        assert {r["doc_id"] for r in rows_of(at)} >= ({1, 2, 3, 4, 5, 8, 9, -3} if name == "odd" else set())
