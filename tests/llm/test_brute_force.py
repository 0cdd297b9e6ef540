"""Operators against plain versions of what they compute."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from hydroframe.llm import ann, bytesops, decontaminate, graph, langid, linededup, mixing, neardup, rindex, suffixdedup, toxicity
from hydroframe.llm.store import Store

SF = "/root/testdata/sf0.01"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORDS.findall((text or "").translate(LOW))


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_classes(rows):
    """Components of multiset Jaccard >= 4/5 over five-word shingles."""
    bags = {}
    for i, t in rows:
        w = words(t)
        bags[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1 if w else 0)))
    parent = {i: i for i in bags}
    ids = sorted(bags)
    for a in ids:
        for b in ids:
            if b < a and bags[a] and bags[b] and 5 * (bags[a] & bags[b]).total() >= 4 * (bags[a] | bags[b]).total():
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {i: find(parent, i) for i in ids}


def brute_lines(rows):
    """{doc: removed line numbers}, {doc: links of its first lines}."""
    first, gone, links = {}, collections.defaultdict(set), collections.Counter()
    for i, t in sorted(rows):
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(words(line))
            if s and s in first:
                gone[i].add(k)
            elif s:
                first[s] = (i, k)
    sets = list(first)
    for s in sets:
        near = [z for z in sets if z != s and 9 * len(s & z) >= 4 * (len(s) + len(z))]
        links[first[s][0]] += len(near)
        if any(first[z] < first[s] for z in near):
            gone[first[s][0]].add(first[s][1])
    return gone, links


def brute_hits(text, items, n=10):
    w, hit, names = words(text), set(), set()
    for item, it in items:
        v = words(it)
        k = min(n, len(v))
        wins = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if v else set()
        for j in range(len(w) - k + 1):
            if tuple(w[j : j + k]) in wins:
                hit |= set(range(j, j + k))
                names.add(str(item))
    return len(w), len(hit), sorted(names)


def test_near_duplicates(docs):
    df, rows = docs
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert got == brute_classes([(r[0], r[1]) for r in rows]) and len(set(got.values())) < len(got)


def test_lines(docs):
    df, rows = docs
    gone, links = brute_lines([(r[0], r[1]) for r in rows])
    report = {r.doc_id: r for r in linededup.line_report(df).collect()}
    assert {i: r.n_removed for i, r in report.items()} == {r[0]: len(gone[r[0]]) for r in rows}
    assert {i: r.n_links for i, r in report.items()} == {r[0]: links[r[0]] for r in rows} and sum(links.values())
    kept = {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()}
    for i, t, *_ in rows:
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        assert kept.get(i) == (left if not gone[i] or words(left) else None)


def test_hot_words_are_split(docs):
    df, rows = docs
    found = linededup.decisions(df, hot=1)
    gone, _ = brute_lines([(r[0], r[1]) for r in rows])
    assert {r.doc_id: set(r.gone) for r in found.collect() if r.gone} == {i: g for i, g in gone.items() if g}


def test_suffix_dedup(docs):
    df, rows = docs
    seen, want = set(), {}
    for i, t, *_ in rows:
        b = t.encode()
        mark = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                mark[k : k + 100] = True
            seen.add(b[k : k + 100])
        left = bytes(np.frombuffer(b, np.uint8)[~mark])
        want[i] = (len(b), int(mark.sum()), int((np.diff(np.r_[0, mark.astype(int)]) == 1).sum()), hashlib.sha256(left).hexdigest())
    for hot in (suffixdedup.HOT, 2):  # with 2 most anchors are cut further
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.suffix_dedup(df, hot).collect()}
        assert got == want and sum(x[1] for x in want.values())


def test_long_document_in_pieces(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(0)
    text = "".join(map(chr, rng.integers(97, 123, 3000)))
    whole = suffixdedup.segments(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    monkeypatch.setattr(suffixdedup, "_PIECE", 500)
    covered = []
    for _, _, buf, offs, base in suffixdedup._pieces(pa.array([text])):
        *_, start, n = suffixdedup.segments(buf, offs)
        covered += [(s + base, s + base + k) for s, k in zip(start, n)]
    assert sum(b - a for a, b in covered) == whole[5].sum() == len(text) - 99
    assert sorted(covered)[0][0] == 0 and all(x[1] == y[0] for x, y in zip(sorted(covered), sorted(covered)[1:]))


def test_hot_anchors_are_cut_into_parts():
    """Parts cover the same windows, and equal windows have equal anchors wherever they stand."""
    rng = np.random.default_rng(2)
    shared = rng.integers(97, 123, 260, dtype=np.uint8)
    texts = [np.concatenate([rng.integers(97, 123, n, dtype=np.uint8), shared, rng.integers(97, 123, 150, dtype=np.uint8)]) for n in (40, 333)]
    owners = []
    for text in texts:
        offs = np.array([0, len(text)])
        whole, parts = (suffixdedup.segments(text, offs, hot=h) for h in (None, np.ones(1 << 23, bool)))
        assert parts[5].max() <= suffixdedup.PART and parts[5].sum() == whole[5].sum() == len(text) - 99
        assert sorted(s + k for s, n in zip(parts[4], parts[5]) for k in range(n)) == list(range(len(text) - 99))
        owners.append({text[s + k : s + k + 100].tobytes(): a for a, s, n in zip(parts[0], parts[4], parts[5]) for k in range(n)})
    both = owners[0].keys() & owners[1].keys()
    assert len(both) >= 161 and all(owners[0][w] == owners[1][w] for w in both)


def test_index():
    rng = np.random.default_rng(0)
    for _ in range(20):
        strings = [bytes(rng.integers(97, 99, rng.integers(1, 40), dtype=np.uint8)) for _ in range(8)]
        offsets = np.cumsum([0] + [len(x) for x in strings])
        index = rindex.RunLengthIndex(np.frombuffer(b"".join(strings), np.uint8), offsets)
        seen, want = set(), []
        for k, s in enumerate(strings):
            for i in range(len(s) - 4):
                if s[i : i + 5] in seen:
                    want.append(int(offsets[k]) + i)
                seen.add(s[i : i + 5])
        assert index.repeats(5).tolist() == want
        for p in (b"a", b"ab", b"bba", b"abab"):
            assert index.count(p) == sum(s[i : i + len(p)] == p for s in strings for i in range(len(s)))


def test_index_memory_follows_runs():
    """Copies of one text add runs only where they differ, and the index holds nothing but runs."""
    rng = np.random.default_rng(3)
    base = rng.integers(97, 123, 2000, dtype=np.uint8)
    sizes = []
    for copies in (4, 64):
        text = np.tile(base, copies)
        text[rng.integers(0, len(text), 20)] = 45
        index = rindex.RunLengthIndex(text, np.arange(copies + 1) * 2000)
        assert index.nbytes() < 60 * len(index.run_start) + 4096
        sizes.append(index.nbytes())
        seen, want = set(), []
        for at in range(len(text)):
            w = text[at : (at // 2000 + 1) * 2000][:50].tobytes()
            if len(w) == 50 and w in seen:
                want.append(at)
            seen.add(w)
        assert index.repeats(50).tolist() == want
        whole = np.concatenate(list(index.matching_statistics(block=777)))
        assert np.array_equal(whole, np.concatenate(list(index.matching_statistics()))) and len(whole) == len(text)
    assert sizes[1] < 2 * sizes[0]


def test_decontamination(spark, docs):
    df, rows = docs
    rng = random.Random(5)
    items = [(k, " ".join(rng.choice(rows)[1].split()[:n])) for k, n in enumerate([12, 3, 25, 10, 1, 40])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (10**6, 3):
        got = {r.doc_id: r for r in decontaminate.digest(decontaminate.contamination(df, bench, max_windows=most)).collect()}
        for i, t, *_ in rows:
            n, hit, names = brute_hits(t, items)
            assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256) == (n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest())
        left = {r.doc_id for r in decontaminate.decontaminate(df, bench, max_windows=most).collect()}
        assert left == {r[0] for r in rows if not brute_hits(r[1], items)[1]}
    assert all(not brute_hits(r.text, [x for x in items if len(words(x[1])) > 3])[1] for r in decontaminate.decontaminate(df, bench.where("length(text) > 20"), mode="spans").collect())


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    element = rng.integers(0, 1 << 48, 80, dtype=np.uint64)
    wa = rng.integers(0, 9, 80)
    wb = np.where(rng.random(80) < 0.6, wa, rng.integers(0, 9, 80))
    j = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    row = np.r_[np.zeros((wa > 0).sum(), int), np.ones((wb > 0).sum(), int)]
    sig = neardup.signatures(row, np.r_[element[wa > 0], element[wb > 0]], np.r_[wa[wa > 0], wb[wb > 0]], 2, 8192)
    assert abs((sig[0] == sig[1]).mean() - j) < 0.025


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(links, "a long, b long"), Store(spark)).collect()}
    parent = {x: x for p in links for x in p}
    for a, b in links:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(parent, x) for p in links if p[0] != p[1] for x in p}


def test_links_in_blocks(spark):
    """A group cut into blocks has the same links as one that is not."""
    rng = random.Random(6)
    sets = {k: sorted({rng.randrange(30) for _ in range(14)}) for k in range(40)}
    rows = [(k, np.array(v, dtype=np.uint64).tobytes(), k, 0) for k, v in sets.items()]
    members = spark.createDataFrame([(k, bytearray(b), d, 0, n) for k, b, d, n in rows], "node long, elements binary, doc long, tx long, line int")
    labels = spark.createDataFrame([(k, 0) for k in sets], "node long, comp long")
    want = {k: [z for z in sets if z != k and 9 * len(set(sets[k]) & set(sets[z])) >= 4 * (len(sets[k]) + len(sets[z]))] for k in sets}
    for block in (3, 512):
        out = graph.verified_links(members, labels, Store(spark), block=block).groupBy("node").agg(F.sum("links").alias("n"), F.min("doc").alias("d")).collect()
        assert {r.node: (r.n, r.d) for r in out} == {k: (len(v), min(v)) for k, v in want.items() if v}


def test_small_sides_and_large_ones(spark, docs):
    df, rows = docs
    ids = spark.createDataFrame([(3,), (5,), (999,)], "doc long")
    for few in (0, 10):
        side = graph.sized(ids, ids.count(), few)
        assert {r.doc_id for r in df.join(side, df.doc_id == F.col("doc"), "left_semi").collect()} == {3, 5}


def test_mixing_budgets(spark):
    rows = [("a", "x", "p", 100), ("a", "x", "q", 1000), ("a", "y", "p", 50), ("b", "x", "p", 5000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    out = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(leaves, F.lit(1000), {"domain": {"a": 1, "b": 1}}, 1).collect()}
    # a has 500: y can take 50 of its 250, the rest goes to its sibling x, where p takes its 100.
    assert out == {("a", "x", "p"): 100, ("a", "x", "q"): 350, ("a", "y", "p"): 50, ("b", "x", "p"): 500}
    out = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(leaves, F.lit(4000), {"domain": {"a": 1, "b": 1}}, 1).collect()}
    assert out == {("a", "x", "p"): 100, ("a", "x", "q"): 1000, ("a", "y", "p"): 50, ("b", "x", "p"): 2850}


def test_mixing_spends_the_budget(docs):
    df, rows = docs
    tokens = sum(len(r[1].split()) for r in rows)
    for num, den in ((1, 2), (5, 2)):
        out = mixing.mix(df, num=num, den=den, max_epochs=4).collect()
        spent = sum(r.n_tokens * r.copies for r in out)
        leaves = len({(r[2], r[3]) for r in rows})
        assert tokens * num // den - leaves * max(len(r[1].split()) for r in rows) <= spent <= tokens * num // den
        assert all(1 <= r.copies <= 5 for r in out)


def test_language_held_out(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.op3_language_id(spark, SF).join(rows.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 200 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.95


def plain_network(p, window):
    """Log probabilities of one window, position by position."""
    emb = [p["emb"][b] for b in [*window, *[0] * (max(langid.WIDTHS) - 1)]]
    best = []
    for f in range(p["conv"].shape[1]):
        width = langid.WIDTHS[f // langid.FILTERS]
        kernel = p["conv"][:, f].reshape(-1, langid.EMBED)
        best.append(max(sum(float(emb[at + k] @ kernel[k]) for k in range(width)) for at in range(len(window))))
    hidden = [max(0.0, b + s) for b, s in zip(best, p["shift"])]
    z = [sum(h * w for h, w in zip(hidden, p["out"][:, c])) + p["bias"][c] for c in range(len(p["bias"]))]
    return np.array(z) - np.log(np.sum(np.exp(z)))


def test_network_against_plain_loops():
    rng = np.random.default_rng(8)
    net = langid.ByteCNN(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) + rng.normal(scale=0.1, size=v.shape) * (v != 0) for k, v in net.p.items()}
    net.p["shift"] = rng.normal(scale=0.2, size=net.p["shift"].shape)
    x, y = rng.integers(97, 110, (4, 24), dtype=np.uint8), np.array([0, 2, 1, 2])
    got = net.log_probs(x)
    assert np.allclose(got, [plain_network(net.p, w) for w in x], atol=1e-9)
    grads = net.gradients(x, y)
    loss = lambda: -net.log_probs(x)[np.arange(4), y].mean()
    for name, g in grads.items():
        at = np.argwhere(np.abs(g) > 1e-6)
        for i in map(tuple, at[rng.permutation(len(at))[:6]]):
            keep, eps = net.p[name][i], 1e-6
            net.p[name][i] = keep + eps
            up = loss()
            net.p[name][i] = keep - eps
            down = loss()
            net.p[name][i] = keep
            assert abs((up - down) / (2 * eps) - g[i]) < 1e-5, (name, i)


def test_training_sample_is_even_and_bounded(spark):
    rows = [(k, f"text number {k} " * 900, "en" if k % 10 else "fr") for k in range(600)] + [(5, "twice", "en")] * 3 + [(None, "no id", "en"), (9, None, "de"), (10, "12", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    fit, langid.ByteCNN.fit = langid.ByteCNN.fit, lambda self, x, y, **kw: seen.update(x=x, y=y, labels=self.labels)
    try:
        langid.train(df, docs=80)
    finally:
        langid.ByteCNN.fit = fit
    assert seen["labels"] == ["en", "fr"] and seen["x"].shape[1] == langid.WINDOW
    assert np.bincount(seen["y"]).tolist()[1] == 40 * 4 and np.bincount(seen["y"])[0] <= 40 * 4


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/../sf0.1/labels.parquet")
    out = toxicity.op5_toxicity(spark, f"{SF}/../sf0.1").join(labels, "doc_id").where("held_out").collect()
    right = [r.toxic == r.predicted for r in out]
    found = [r.predicted for r in out if r.toxic]
    assert sum(right) / len(right) > 0.97 and sum(found) / len(found) > 0.85


def plain_outputs(text, stems, weak, x):
    """What the grammar's layers write, by rules on lists of words."""
    events, last, at = [], None, 0
    for clause in re.split(r"[.!?;\n]", text.lower()):
        sym = []
        for w in re.findall(r"[^\W\d_]+", clause):
            begins = lambda s, w=w: w == s.strip() if s.endswith(" ") else w.startswith(s)
            kinds = [("I", any(map(begins, stems))), ("W", any(map(begins, weak))), ("T", w in x.threats), ("N", w in x.negations), ("R", w in x.reports), ("G", w in x.targets)]
            sym.append(next((k for k, yes in kinds if yes), "O"))
        neg = [{"I": "i", "W": "O", "T": "t"}.get(s, s) if "N" in sym[max(0, i - 2) : i] else s for i, s in enumerate(sym)]
        one = ["J" if s == "I" and "G" in neg[max(0, i - 3) : i] else s for i, s in enumerate(neg)]
        two, three, free = list(one), [], None
        for opener, reach, name in (("I", 2, "J"), ("T", 3, "U")):
            free = None
            for i, s in enumerate(list(two)):
                if s == "G" and free is not None and i - free <= reach:
                    two[i], free = name, None
                elif s == opener:
                    free = i
        for i, s in enumerate(two):
            three.append({"I": "q", "J": "q", "W": "O", "T": "p", "U": "p"}.get(s, s) if "R" in sym[:i] else s)
        out = [s for s in three if s in toxicity.OUTPUTS]
        if out:
            events += ["|"] * (last is not None and at - last > toxicity.SPAN) + out
            last = at + len(clause)
        at += len(clause) + 1
    seen, kept = False, []
    for s in events:
        if s == "W" and not seen:
            s, seen = "O", True
        seen = s != "|" and (seen or s in "IJTUW")
        kept.append(s)
    return collections.Counter(s for s in kept if s in toxicity.OUTPUTS)


def test_grammar_against_plain_rules():
    rng = random.Random(21)
    stems, weak, x = frozenset({"idio", "scum "}), frozenset({"dunc"}), toxicity.Lexicon()
    grammar = toxicity.Grammar(stems, weak, {s: rng.uniform(-1, 3) for s in toxicity.OUTPUTS}, -2.0)
    matcher = grammar.matcher()
    pool = ["idiot", "idiots", "scum", "scummy", "dunce", "dunces", "kill", "hurt", "töten", "you", "them", "her", "not", "never", "said", "wrote", "house", "tree", "Blue", "l'idiot", "x9", "idioidio"]
    several = 0
    for _ in range(400):
        parts = [rng.choice(pool) + rng.choice([" ", " ", " ", " ", ", ", ". ", "\n", "! "]) for _ in range(rng.randrange(1, 40))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), "filler words " * rng.choice([3, 120]))
        text = "".join(parts)
        want = plain_outputs(text, stems, weak, x)
        assert matcher.outputs(text) == want, text
        z = grammar.bias + sum(grammar.weights[s] * toxicity.strength(want[s] + (want["J"] if s == "I" else 0)) for s in toxicity.OUTPUTS)
        assert abs(matcher.score(text) - 1 / (1 + np.exp(-z))) < 1e-12
        several += len(want) > 2
    assert several > 50


def test_transducers_compose():
    fst = toxicity.clause_grammar()
    run = lambda s: "".join(fst.run(s))
    assert run("OIO") == "OIO" and run("NI") == "Ni" and run("NOI") == "NOi" and run("NOOI") == "NOOI"
    assert run("ROI") == "ROq" and run("GOI") == "GOJ" and run("GNI") == "GNi" and run("NT") == "Nt" and run("RT") == "Rp"
    assert run("WNWRW") == "WNORO" and run("TOG") == "TOU" and run("NTG") == "NtG" and run("RTG") == "Rpp" and run("IG") == "IJ"
    weak = toxicity.Grammar(frozenset(), frozenset({"dunce"}), {"W": 9.0}, -3.0).matcher()
    assert weak.score("a dunce") < 0.1 and weak.score("a dunce. Two dunces") > 0.9
    assert weak.score("a dunce. " + "x " * 3000 + ". Two dunces") < 0.1 and weak.score("a dunce. Two dunces" + " x" * 30000) > 0.9
    g = toxicity.Grammar(frozenset({"idiot"}), frozenset(), {"I": 5.0}, -3.0).matcher()
    assert g.score("You fool. An IDIOT here") > 0.8 and g.score("not an idiot") < 0.1 and g.score("xidiot") < 0.1


def test_neighbour_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    got = collections.defaultdict(dict)
    for r in ann.op7_nearest_neighbours(spark, SF).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    recall = []
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        mine = [got[ids[k]][n] for n in range(1, 21)]
        assert all(abs(sc - x[np.flatnonzero(ids == v)[0]] @ x[k]) < 1e-12 for v, sc in mine)
        assert mine == sorted(mine, key=lambda p: (-p[1], p[0]))
        recall.append(len({v for v, _ in mine} & set(ids[best])) / 20)
    assert np.mean(recall) >= 0.9


def test_probe_is_complete():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (500, 8), dtype=np.uint8)
    for parts in ann.PARTS:
        index = ann.MultiIndex(codes, parts)
        for r in (0, 5, 17, 24, 31, 64):
            for q in codes[:5] ^ np.uint8(5):
                assert index.probe(q, r).tolist() == np.flatnonzero(ann.hamming(codes, q) <= r).tolist()


def test_probed_share_on_structured_vectors():
    """Where neighbours agree in most bits, probing reads a small part of the block, and finds them."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(400, 64))
    x = centres[rng.integers(0, 400, 8000)] + 0.08 * rng.normal(size=(8000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    coder = ann.Coder(x[:4096])
    radius = ann.learn_radius(coder, x[:4096], 4)
    codes, read, hit = coder(x), [], []
    parts = ann.best_parts(radius, len(codes))
    index = ann.MultiIndex(codes, parts)
    for q in range(0, 8000, 160):
        read.append(sum(int((hi - lo).sum()) for lo, hi in index.lists(codes[q].view(np.uint64)[0], radius)) / 8000)
        near = np.argsort(-(x @ x[q]))[1:11]
        hit.append(np.isin(near, index.probe(codes[q], radius)).mean())
    assert parts and np.mean(read) < 0.1 and np.mean(hit) > 0.9
    # The index and the direct comparison of codes retrieve the same rows.
    pairs = zip(ann.retrieve(codes, codes[:300], radius, parts), ann.retrieve(codes, codes[:300], radius, 0), strict=True)
    assert all(a == b and np.array_equal(v, w) for (a, v), (b, w) in pairs)
    assert ann.best_parts(30, 8192) == 0  # lists longer than the block


def test_neighbours_do_not_depend_on_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(300, 16)), 1)
    x[100:180] = x[7]  # ties beyond k
    rows = [(int(k), v.tolist()) for k, v in enumerate(x)] + [(250, x[7].tolist()), (250, x[250].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    every = {(i, tuple(v)) for i, v in rows}
    for block in (50, 8192):
        monkeypatch.setattr(ann, "BLOCK", block)
        monkeypatch.setattr(ann, "COVER", 1.0)
        got = collections.defaultdict(list)
        for r in sorted(ann.neighbours(df, df.where("vec_id % 20 = 0")).collect(), key=lambda r: (r.query_id, r["rank"])):
            got[r.query_id].append(r.vec_id)
        for q in range(0, 300, 20):
            score = {}
            for i, v in every:
                if i != q:
                    score[i] = max(score.get(i, -np.inf), float(np.einsum("i,i->", x[q], np.array(v))))
            want = sorted(score, key=lambda i: (-score[i], i))[:20]
            assert len(got[q]) == 20 and len(set(got[q]) & set(want)) >= 15
            if q == 120:
                assert got[q] == want  # equal vectors, smallest ids first


def test_words_are_the_contract_s():
    text = "Ab-c D9é中 x \x7f_y{Z}"
    raw = np.frombuffer(text.encode(), np.uint8)
    low, s, e, _, _ = bytesops.words(raw, np.array([0, len(raw)]))
    assert [low[a:b].tobytes().decode() for a, b in zip(s, e)] == words(text)


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    df, rows = docs
    rng = random.Random(8)
    filler = lambda n: " ".join(f"w{rng.randrange(400):x}" for _ in range(n))
    toxic = [(100 + k, f"{filler(9)} nitwit {filler(9)}", "en", "src1", 9) for k in range(40)]
    items = [(1, " ".join(rows[0][1].split()[:12]))]
    for name, t in {"documents": df.union(spark.createDataFrame(toxic, df.schema)), "labels": spark.createDataFrame([(r[0], 1, 0) for r in rows] + [(r[0], 0, 1) for r in toxic], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame(items, "item_id long, text string")}.items():
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    at, store = spark.read.parquet(f"{tmp_path}/documents.parquet"), Store(spark)
    state = [(r[0], r[1]) for r in rows]
    grammar = toxicity.learn(at, spark.read.parquet(f"{tmp_path}/labels.parquet").where(~toxicity.held_out()))
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, store.write(stage(spark, at, str(tmp_path)))
        if name == "toxicity":
            plain = lambda t: grammar.bias + sum(grammar.weights.get(k, 0) * x for k, x in toxicity.features(plain_outputs(t, grammar.stems, grammar.weak, grammar.lexicon)).items())
            assert {i for i, t in [*state, *((r[0], r[1]) for r in toxic)] if plain(t) < 0} == {i for i, _ in state}
        elif name == "line_dedup":
            gone, _ = brute_lines(state)
            state = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])) for i, t in state]
            state = [(i, t) for i, t in state if not gone[i] or words(t)]
        elif name == "near_dedup":
            c = brute_classes(state)
            state = [(i, t) for i, t in state if c[i] == i]
        elif name == "decontamination":
            state = [(i, t) for i, t in state if not brute_hits(t, items)[1]]
        if name == "mixing":
            con = duckdb.connect()
            con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{before._hydroframe_path.removeprefix('file:')}/*.parquet')")
            want = con.execute(f"SELECT doc_id, domain, lang, source, n_tokens, copies FROM ({mixing.SQL})").fetchall()
            assert sorted(want) == sorted((r.doc_id, r.domain, r.lang, r.source, r.n_tokens, r.copies) for r in at.collect()) and want
        else:
            assert at.columns == df.columns
            assert {(r.doc_id, r.text) for r in at.collect()} == set(state), name
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {r.doc_id for r in at.collect()}


def test_native_plans(spark, docs):
    """Mixing and chat formatting run no Python on the executors and never shuffle a text."""
    from hydroframe.llm import chat

    df, _ = docs
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    mixed = plan(mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")))
    talks = plan(chat.rotate(spark.read.parquet(f"{SF}/conversations.parquet")))
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", mixed + talks)
    assert "Exchange hashpartitioning" not in mixed
