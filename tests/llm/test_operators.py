"""Each operator against a brute-force version, on awkward rows, empty tables and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from litmill.llm import contamination, jaccard, neighbours, personal, pieces, preference, rules, sharding, substrings, tokenfiles
from litmill.llm.common import find_words
from litmill.scale import new_path


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- 7: rules ---------------------------------------------------------------


def measured(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_rules_measure_whole_texts(docs, odd, rows, empty):
    want = sorted(((i, *measured(t)) for i, t in rows), key=repr)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got(rules.ledger(docs).select(*columns)) == want
    assert got(rules.ledger(odd).select(*columns)) == want
    assert rules.ledger(empty).count() == 0


def test_rules_policies_and_ablations(docs, odd):
    entries = rules.ledger(docs)
    kept = rules.apply_policy(entries, "base-1").filter("kept").count()
    bits = [r["fail_bits"] for r in entries.select("fail_bits").collect()]
    mask = rules.mask_of("base-1")
    assert kept == sum(not b & mask for b in bits)
    for r in rules.ablations(entries, "base-1").collect():
        bit = rules.BIT[r["rule"]]
        assert r["n_failed"] == sum(bool(b & bit) for b in bits)
        assert r["n_only"] == sum(b & mask == bit for b in bits)
        assert r["kept_without"] == sum(not b & mask & ~bit for b in bits)
    good = rules.keep_good(odd)
    assert good.columns == odd.columns and good.count() == rules.apply_policy(entries).filter("kept").count()


def test_rules_plan_is_native(docs):
    plan = rules.apply_policy(rules.ledger(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 8: shards --------------------------------------------------------------


def least_greedy(sizes, n):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, parts, at = (low + high) // 2, 1, 0
        for s in sizes:
            if at + s > mid:
                parts, at = parts + 1, 0
            at += s
        low, high = (low, mid) if parts <= n else (mid + 1, high)
    return low


@pytest.mark.parametrize("n", [1, 3, 8])
def test_shards_are_minimax(docs, rows, n):
    out = sharding.shards(docs, n).collect()
    assert len(out) == len(rows)
    groups, first = defaultdict(int), {}
    for i, t in rows:
        key = t or ""
        groups[key] += len(key.encode()) + 1
        first[key] = min([x for x in (first.get(key), i) if x is not None], default=None)
    order = sorted(groups, key=lambda k: (first[k] is not None, first[k] or 0, hashlib.md5(k.encode()).digest()))
    best = least_greedy([groups[k] for k in order], n)
    loads, slots, by_text = Counter(), defaultdict(list), defaultdict(set)
    for r in out:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        by_text[(r["size"], r["text_crc32"])].add(r["shard"])
    assert max(loads.values()) == best and set(loads) <= set(range(n))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in by_text.values())


def test_shards_of_nothing(empty, odd, docs):
    assert sharding.shards(empty).count() == 0
    assert got(sharding.shards(odd)) == got(sharding.shards(docs))


# --- 1: preference pairs ----------------------------------------------------


def test_preference_pairs(spark):
    turns = [
        (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "hi"), (3, 1, "assistant", "no"), (3, 2, "user", None),
        (4, 0, "user", "same"), (5, 0, "user", "same"), (8, 0, None, "x"), (None, 0, "user", "lost"), (8, 0, None, "x"),
    ]
    df = spark.createDataFrame([(*t, "own") for t in turns], "conv_id long, turn long, role string, text string, pair_id string")
    out = {r["pair_id"]: r for r in preference.format_pairs(preference.neighbour_pairs(df)).collect()}
    assert set(out) == {1, 2, 4}
    assert out[1]["n_common"] == 1 and out[1]["prompt"] == "<|user|>\nhi<|end|>\n"
    assert out[1]["chosen"] == "<|assistant|>\nyes<|end|>\n"
    text, spans = out[1]["rejected"], out[1]["rejected_learned"]
    assert [text[s["start"] : s["end"]] for s in spans] == ["no<|end|>\n"]
    assert (out[2]["n_common"], out[2]["chosen"], out[2]["rejected"]) == (1, "", "")
    assert out[4]["n_common"] == 0 and out[4]["chosen"].count("x<|end|>") == 2 and out[4]["rejected_learned"] == []
    assert preference.format_pairs(preference.neighbour_pairs(df.limit(0))).count() == 0
    names = ("n_common", "prompt", "chosen_learned", "_same", "kept")
    own = preference.format_pairs(preference.neighbour_pairs(df).withColumns({n: F.lit("own") for n in names})).collect()
    assert all(r["kept"] == r["_same"] == "own" and r["n_common"] == out[r["pair_id"]]["n_common"] for r in own)
    assert all(r["prompt"] == out[r["pair_id"]]["prompt"] for r in own)


# --- 2: neighbours ----------------------------------------------------------


def test_neighbour_votes(spark, docs, empty):
    good = [(i, f"the quick brown fox number{i} jumps over lazy dogs and runs home") for i in range(40)]
    junk = [(100 + i, "BUY!! NOW!! ### " * 12 + str(i)) for i in range(40)]
    known = spark.createDataFrame(good + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in junk] + [(None, 1), (7, None)], "doc_id long, label int")
    model = neighbours.fit(known, labels)
    out = {r["doc_id"]: r["score"] for r in neighbours.score(known, model).collect()}
    assert min(out[i] for i, _ in good) > 0.9 and max(out[i] for i, _ in junk) < 0.1
    body = good[3][1]
    cosine = model.latent([body]) @ model.vectors.T
    near = np.argsort(-cosine[0], kind="stable")[: neighbours.NEIGHBOURS]
    w = np.clip(cosine[0, near], 0, 1).astype(float) ** neighbours.SHARPNESS + 1e-6
    assert model.scores([body])[0] == pytest.approx(float((w * model.labels[near]).sum() / w.sum()), abs=1e-3)
    scored = neighbours.score(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert neighbours.score(empty, model).count() == 0
    blank = neighbours.fit(empty.select("doc_id", "text"), labels.limit(0))
    assert {r["score"] for r in neighbours.score(docs, blank).collect()} == {0.5}


def test_repeated_documents_do_not_crowd_out_labels(spark):
    good = [(i, f"the quick brown fox number{i} jumps over lazy dogs and runs home") for i in range(20)]
    junk = [(100 + i, "BUY!! NOW!! ### " * 12 + str(i)) for i in range(20)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] * 3 + [(i, 0) for i, _ in junk], "doc_id long, label int")
    once = neighbours.fit(spark.createDataFrame(good + junk, "doc_id long, text string"), labels, rows=40)
    repeated = spark.createDataFrame(good + junk + [junk[0]] * 60, "doc_id long, text string").repartition(5)
    model = neighbours.fit(repeated, labels, rows=40)
    assert sorted(model.labels) == sorted(once.labels) == [0.0] * 20 + [1.0] * 20
    out = {r["doc_id"]: r["score"] for r in neighbours.score(repeated, model).collect()}
    assert min(out[i] for i, _ in good) > 0.9 and max(out[i] for i, _ in junk) < 0.1
    # Other texts under one doc_id: one vector, the same in any order of the table.
    several = [(5, f"text {k} of five") for k in range(30)]
    label = spark.createDataFrame([(5, 1)], "doc_id long, label int")
    fits = [neighbours.fit(spark.createDataFrame(x, "doc_id long, text string"), label) for x in (several, several[::-1])]
    assert [len(m.labels) for m in fits] == [1, 1] and np.allclose(fits[0].basis, fits[1].basis)


# --- 3: token files ---------------------------------------------------------


def test_token_files_round_trip(spark, docs, rows, odd, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenfiles.default_vocabulary())
    path = new_path(spark, "test-tokens")
    tokenfiles.write_tokens(odd, path)
    out = tokenfiles.read_digests(spark, path).collect()
    want = sorted((str(i), n, crc) for i, n, crc in ((i, *summary(whole, t)) for i, t in rows))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in out) == want
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    scan = spark.read.parquet(path).select("n_tokens")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<n_tokens:bigint>" in scan
    none = new_path(spark, "test-tokens")
    tokenfiles.write_tokens(empty, none)
    assert tokenfiles.read_digests(spark, none).count() == 0


def test_token_files_keep_added_tokens(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenfiles.default_vocabulary())
    bodies = [
        "a<|endoftext|>b", "<|endoftext|>", "one two <|endoftext|> three", "x <|endoftext|>", "<|endoftext|><|endoftext|> y\n",
        "<|endof text|> no token", "plain words", "  <|endoftext|>  日本", "<|endoftext|", None,
    ]
    assert whole.encode(bodies[0], add_special_tokens=False).ids == [64, 50256, 65]
    path = new_path(spark, "test-tokens")
    tokenfiles.write_tokens(spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string"), path)
    out = sorted(tokenfiles.read_digests(spark, path).collect())
    assert [(r["n_tokens"], r["ids_crc32"]) for r in out] == [summary(whole, t) for t in bodies]


def test_encoder_equals_the_library(rows, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokenfiles.WordPool, "LIMIT", 40)
    encoder = tokenfiles.Encoder(tokenfiles.default_vocabulary())
    bodies = [t for _, t in rows] + [
        None, "", " ", "  a", "a  b", "a ", " a", "\n a", "a \n", "a<|endoftext|>b", "日本 語 x", "don't 's 'll x\'s", "a\xa0b c\x1c d",
        "\u0120 x \u0120y", "\u2003a \u3000 b", "é ñ ß", "1 2a b3 4.5", "x\x00 y", " \u2028 z", "tab\tb c",
    ]
    column = pa.array(bodies, pa.string())
    for most in (100, 1 << 20):
        for first, n in tokenfiles.slices(column, most):
            sizes, ids = encoder(column.slice(first, n))
            at = 0
            for body, size in zip(bodies[first : first + n], sizes):
                assert list(ids[at : at + size]) == encoder.whole.encode(body or "", add_special_tokens=False).ids
                at += size
            assert at == len(ids)


def summary(whole, t):
    ids = [*whole.encode(t or "", add_special_tokens=False).ids, tokenfiles.END_ID]
    return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())


# --- 4: repeated passages ---------------------------------------------------


def brute_removed(rows, window):
    first = defaultdict(lambda: float("inf"))
    for i, t in rows:
        w = find_words(t or "")
        for k in range(len(w) - window + 1):
            if i is not None:
                first[tuple(w[k : k + window])] = min(first[tuple(w[k : k + window])], i)
    out = []
    for i, t in rows:
        w = find_words(t or "")
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [50, 12])
def test_repeated_passages(docs, odd, rows, empty, window):
    columns = ("doc_id", "n_words", "n_removed", "kept")
    want = brute_removed(rows, window)
    assert got(substrings.remove_repeats(docs, window).select(*columns)) == want
    if window == 50:
        assert got(substrings.remove_repeats(odd, window).select(*columns)) == want
        assert substrings.remove_repeats(empty, window).count() == 0


# --- 5: pieces --------------------------------------------------------------


def spellings(lattice, s):
    out = []

    def go(at, cuts, score):
        if at == len(s):
            out.append((-score, tuple(cuts[-2::-1]), lattice.spell(s, cuts)))
            return
        for end in range(at + 1, len(s) + 1):
            for start, x in lattice.edges(s, end):
                if start == at:
                    go(end, [*cuts, end], score + x)

    go(0, [0], 0)
    return sorted(out)


def test_pieces_n_best_is_exact(rows):
    coder = pieces.Coder(pieces.default_model())
    for text in ("the inn", "gé 日x", "aaa", "then there", "x", "a  b"):
        s = pieces.marked(text)
        every = spellings(coder.lattice, s)
        assert coder.lattice.n_best(s, 6) == [(-score, ids) for score, _, ids in every[:6]]
        assert [x for x, _ in coder.n_best(text, 4)] == [-x for x, _, _ in every[:4]]
        assert coder.lattice.decode(coder.n_best(text, 1)[0][1]) == text
    for _, t in rows:
        assert coder.lattice.decode(coder.encode(t or "", 3)[0]) == (t or "").replace(pieces.MARK, " ")


def test_pieces_beside_the_library(spark, sf):
    """The lattice's ids differ from the library's BPE ids, as stated, and never score less."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    lattice = pieces.Lattice(pieces.default_model())
    bodies = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    count = Counter(w for t in bodies for w in t.split())
    words = sorted(count)
    differ = 0
    for word, (ids, score, _) in zip(words, lattice.best([pieces.marked(w) for w in words])):
        own = sp.encode(word)
        if not any(sp.is_byte(i) for i in (*own, *ids)):
            assert lattice.decode(own) == lattice.decode(ids) == word
            assert score >= sum(sp.get_score(i) for i in own)
            differ += count[word] * (ids != own)
    assert 0.3 < differ / sum(count.values()) < 0.6
    assert "SentencePiece" in pieces.__doc__


def test_pieces_in_frames(docs, odd, empty):
    out = pieces.encode(odd, n_best=2)
    assert set(odd.columns) | {"edits"} == set(out.columns) and out.count() == docs.count()
    back = pieces.decode(pieces.encode(docs)).filter("not (decoded <=> coalesce(text, ''))")
    assert back.count() == 0
    assert pieces.encode(empty).count() == 0 and pieces.digests(empty).count() == 0
    coder = pieces.Coder(pieces.default_model())
    want = {}
    for r in docs.filter("length(text) < 2000 and doc_id is not null").collect():
        best = coder.n_best(r["text"] or "", pieces.N_BEST)
        want[r["doc_id"], r["text"]] = [zlib.crc32(np.array(ids, "<u4").tobytes()) for _, ids in best]
    met = pieces.digests(docs.filter("length(text) < 2000 and doc_id is not null")).collect()
    assert sorted(tuple(r["ranks_crc32"]) for r in met) == sorted(map(tuple, want.values())) or len(met) > len(want)
    marks = docs.sparkSession.createDataFrame([(1, "a\u2581b"), (2, "a b")], "doc_id long, text string")
    assert {r["doc_id"]: r["round_trip"] for r in pieces.digests(marks).collect()} == {1: False, 2: True}


# --- 6: Jaccard join --------------------------------------------------------


def brute_classes(rows):
    sets = [set(jaccard.grams(t or "").tolist()) for _, t in rows]
    root, links = list(range(len(rows))), Counter()

    def top(i):
        return i if root[i] == i else top(root[i])

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                    links[i] += 1
                    links[j] += 1
                    root[max(top(i), top(j))] = min(top(i), top(j))
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[top(i)].append(i)
    least = {c: min((rows[i][0] for i in m if rows[i][0] is not None), default=None) for c, m in classes.items()}
    return [(rows[i][0], least[top(i)], links[i]) for i in range(len(rows))], len(classes)


def test_jaccard_classes(docs, odd, rows, empty):
    want, n_classes = brute_classes(rows)
    out = jaccard.near_classes(docs)
    assert got(out.select("doc_id", "class_id").filter("doc_id is not null")) == sorted(
        ((i, c) for i, c, _ in want if i is not None), key=repr
    )
    by_id = {i: n for i, _, n in want if i is not None}
    assert {r["doc_id"]: r["n_links"] for r in out.filter("doc_id is not null").collect()} == by_id
    kept = jaccard.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == n_classes
    assert jaccard.near_classes(empty).count() == 0 and jaccard.keep_first(empty).count() == 0


def test_jaccard_blocks_agree(spark, monkeypatch):
    base = [f"t{i}" for i in range(120)]
    many = [(i, " ".join([*base[:i], f"edit{i}", *base[i + 1 :]])) for i in range(60)]
    df = spark.createDataFrame(many, "doc_id long, text string")
    whole = got(jaccard.near_classes(df))
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    assert got(jaccard.near_classes(df)) == whole
    monkeypatch.setattr(jaccard, "BLOCK", 2048)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 9000)
    assert got(jaccard.near_classes(df)) == whole


def test_jaccard_links_rows_without_id(spark):
    base = [f"t{i}" for i in range(100)]
    texts = [" ".join([*base[:i], f"edit{i}", *base[i + 1 :]]) for i in (3, 50, 80)]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (None, texts[0]), (7, "another text under the same id as before")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row_key", F.lit("own"))
    out = jaccard.near_classes(df)
    assert got(out.select("doc_id", "class_id", "n_links")) == sorted(
        [(None, 7, 3), (None, 7, 3), (None, 7, 3), (7, 7, 3), (7, 7, 0)], key=repr
    )
    kept = jaccard.keep_first(df)
    assert kept.columns == df.columns and sorted(r["text"] for r in kept.collect()) == sorted([rows[4][1], texts[2]])


def test_jaccard_recall(spark):
    """Measured: every pair of texts at 0.8 or more, by brute force, against the links found."""
    rnd = np.random.default_rng(2)
    rows = []
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(90)]
        rows.append(" ".join(base))
        for _ in range(3):
            words = list(base)
            for at in rnd.choice(90, rnd.integers(1, 4), replace=False):
                words[at] = f"x{rnd.integers(1 << 40)}"
            rows.append(" ".join(words))
    sets = [set(jaccard.grams(t).tolist()) for t in rows]
    links = [sum(len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    found = jaccard.near_classes(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    asked = [(r["doc_id"], r["n_links"]) for r in found.collect()]
    assert all(n <= links[i] for i, n in asked)
    assert sum(n for _, n in asked) >= 0.99 * sum(links) > 100


def test_jaccard_ships_texts_once(spark):
    """A long chain and a large group of near copies: each text goes to as many tasks as there are blocks."""
    chain = [f"c{i}" for i in range(700)]
    rows = [(i, " ".join(chain[2 * i : 2 * i + 60])) for i in range(320)]
    rows += [(1000 + i, " ".join([*(f"n{k}" for k in range(80)), f"edit{i}"])) for i in range(700)]
    sets = [set(jaccard.grams(t).tolist()) for _, t in rows]
    bands, n = jaccard.bands_for(jaccard.SIMILARITY, jaccard.RECALL)
    signs = np.array([jaccard.signature(np.array(sorted(s), np.uint64), bands, n).view(np.int64) for s in sets])
    links, roots = jaccard.linked([np.array(sorted(s), np.uint64) for s in sets], signs, np.ones(len(sets), np.int64), None, 0.8)
    want = [sum(len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets[:320])]
    assert sum(links[:320]) >= 0.97 * sum(want) and set(links[320:]) == {699}
    assert len({roots.top(i) for i in range(320, 1020)}) == 1
    found = jaccard.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id >= 1000")
    assert {(r["class_id"], r["n_links"]) for r in found.collect()} == {(1000, 699)}


def test_bands_reach_the_recall():
    bands, size = jaccard.bands_for(0.8, 0.995)
    assert 1 - (1 - 0.8**size) ** bands >= 0.995 and bands * size <= jaccard.MOST_HASHES


# --- 9: decontamination -----------------------------------------------------

ITEMS = [
    (1, "What is the deepest lake that lies between these two old hills? It is the blue lake of Orm."),
    (2, "Name the river which crosses the grey plain after rain. The answer is the long river Sool."),
    (3, None), (4, ""), (2, "Name the river which crosses the grey plain after rain. The answer is the long river Sool."),
]


def test_search_finds_all_at_the_threshold():
    index = contamination.Index.build([(i, " ".join(f"v{(i * 7 + k * k) % 90}" for k in range(20))) for i in range(80)])
    for seed in range(30):
        asked = {f"v{(seed * 11 + k * 3) % 90}" for k in range(25)}
        for threshold in (0.05, 0.3, 0.6):
            score = defaultdict(float)
            for t in asked:
                for u, v in zip(index.units.get(t, ()), index.impacts.get(t, ())):
                    score[u] += v
            want = {u for u, v in score.items() if v >= threshold - 1e-9}
            assert {u for u, _ in index.search(asked, threshold)} == want


def test_leaks(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    filler = " ".join(f"fill{i}" for i in range(300))
    held = [(1, f"{filler} {ITEMS[0][1]} {filler}"), (2, ITEMS[1][1]), (2, ITEMS[1][1]), (3, ITEMS[1][1].split(".")[0]), (4, filler), (5, None)]
    df = spark.createDataFrame(held, "doc_id long, text string")
    found = got(contamination.find_leaks(df, items).select("doc_id", "item_id"))
    assert found == [(1, 1), (2, 2), (2, 2)]
    assert got(contamination.drop_leaks(df, items).select("doc_id")) == [(3,), (4,), (5,)]
    assert contamination.find_leaks(docs, items).count() == 0
    assert contamination.find_leaks(empty, items).count() == 0
    assert contamination.find_leaks(df, items.limit(0)).count() == 0


def test_leaks_do_not_depend_on_the_number_of_indexes(spark):
    items = spark.createDataFrame([(i, " ".join(f"q{i}x{k}" for k in range(30)) + ".") for i in range(20)], "item_id long, text string")
    df = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("some words before "), "text").alias("text"))
    assert len(list(contamination.indexes(items, most_bytes=600))) > 3
    assert set(got(contamination.find_leaks(df, items).select("doc_id", "item_id"))) == {(i, i) for i in range(20)}


def test_leaks_of_repeated_and_missing_ids(spark):
    bodies = [" ".join(f"{name}{k}" for k in range(40)) + "." for name in ("a", "b", "c", "d")]
    items = spark.createDataFrame([(1, bodies[0]), (1, bodies[1]), (None, bodies[2]), (None, bodies[3])], "item_id long, text string")
    held = [(0, bodies[0]), (1, bodies[1]), (2, bodies[2]), (3, " ".join(bodies)), (3, " ".join(bodies)), (4, "none of them")]
    df = spark.createDataFrame(held, "doc_id long, text string")
    want = sorted([(0, 1), (1, 1), (2, None), *[(3, 1), (3, None), (3, None)] * 2], key=repr)
    for most_bytes in (contamination.INDEX_BYTES, 200):
        assert got(contamination.find_leaks(df, items, most_bytes=most_bytes).select("doc_id", "item_id")) == want
    assert got(contamination.drop_leaks(df, items).select("doc_id")) == [(4,)]


def test_leak_scores_do_not_depend_on_the_number_of_indexes(spark):
    rows = [(i, " ".join(f"q{(i * k) % 40}x{k % 7}" for k in range(30 + i)) + ".") for i in range(1, 20)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    whole = contamination.Index.build(rows)
    cut = list(contamination.indexes(items, most_bytes=900))
    assert len(cut) > 2
    for index in cut:
        for term in index.units:
            at = dict(zip(((whole.ids[whole.items[u]]) for u in whole.units[term]), whole.impacts[term]))
            for u, impact in zip(index.units[term], index.impacts[term]):
                assert impact == pytest.approx(at[index.ids[index.items[u]]])


# --- 10: personal data ------------------------------------------------------


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m.group())
        if 14 <= len(d) <= 19 and personal.luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], personal.KINDS.index(s[0])))


def test_base_spans_match_the_patterns(rows):
    odd = ["a@b.c@d.e f@g.h", "1.2.3.4.5.6.7.8", "++1 555 555 5555 5+1", "4111-1111-1111-1111-", "@x.y a@@b.c", "é+49 (30) 1234567"]
    for t in [t for _, t in rows if t and len(t) < 5000] + odd:
        assert personal.base_spans(t) == brute_spans(t)
    assert personal.base_spans("a" * 200_000 + "1" * 200_000 + "." * 10) == []
    assert personal.all_spans("a" * 200_000 + " x (at) y", {}) == ([], [])


def test_personal_rows_and_masks(docs, odd, rows, empty):
    out = {(r["doc_id"], r["base_sha256"]): r for r in personal.find(docs).collect()}
    for i, t in rows:
        text = personal.joined(personal.base_spans(t or ""))
        assert (i, hashlib.sha256(text.encode()).hexdigest()) in out
    assert personal.find(docs).count() == len(rows) and personal.find(empty).count() == 0
    masked = personal.redact(odd)
    assert masked.columns == odd.columns and masked.filter("text is null").count() == 2
    assert masked.filter("doc_id = 10").first()["text"] == "mail [EMAIL] or [PHONE] now"


def test_labelers_are_weighed_and_spans_added():
    votes = np.array([[1, 1, 0], [1, -1, 0], [-1, -1, 0], [1, 1, 1]])
    posterior, accuracy, _ = personal.reliabilities(votes, np.array([50.0, 5.0, 40.0, 20.0]))
    assert posterior[0] > 0.9 and posterior[2] < 0.1 and (accuracy > 0.5).all()
    text = "write to jane (at) mail (dot) com or call 555-123-4567 and card 4111111111111111"
    patterns = Counter(
        k + "," + ",".join(map(str, v)) for k, _, _, v in personal.candidates(text, personal.base_spans(text)) for _ in range(20)
    )
    model = personal.train_spans(sorted(patterns.items()))
    base, spans = personal.all_spans(text, model)
    assert set(base) <= set(spans) and ("email", 9, 33) in spans
    # Patterns that training never met are judged by the weights.
    yes, no = (0, 1, 1, 1, 0, 0, 2, 2, 0), (0, -1, -1, 0, -1, -1, 2, 2, 2)
    for other in (model, personal.train_spans([])):
        assert other.probability("card", yes) > 0.5 > other.probability("card", no)


def test_wide_candidates_by_brute_force(rows):
    for _, t in rows:
        t = t or ""
        base = personal.base_spans(t)
        want = [(k, a, b) for k, a, b in base]
        for kind, wide in personal._WIDE.items():
            for m in wide.finditer(t):
                if all(k != kind or b <= m.start() or a >= m.end() for k, a, b in base):
                    want.append((kind, *m.span()))
        assert sorted(want) == sorted((k, a, b) for k, a, b, _ in personal.candidates(t, base))


# --- SQL twins ---


@pytest.mark.parametrize("name", ["op1_preference_pairs", "op7_rule_ledger", "op11_source_divergence", "op12_ranked_search"])
def test_query_matches_its_sql(spark, sf, name):
    import duckdb

    from litmill import llm
    from tools.check import table_key

    queries, oracles = llm.load()
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df, cur = queries[name](spark, sf), con.execute(oracles[name])
    assert table_key(df.columns, [tuple(r) for r in df.collect()]) == table_key([d[0] for d in cur.description], cur.fetchall())


# --- pipeline ---------------------------------------------------------------


def test_pipeline_matches_its_parts(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    good = []
    for i, t in rows:
        n, _, symbols, _, repeated = measured(t)
        if n >= 10 and 100 * repeated <= 20 * n and 10 * symbols <= n:
            good.append((i, t))
    classes, _ = brute_classes(good)
    index = contamination.Index.build(items)
    clean = {i for i, c, _ in classes if i == c} - {i for i, t in good if index.leaks(t)}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(out) == clean
    whole = dict(good)
    coder = pieces.Coder(pieces.default_model())
    for i, r in out.items():
        assert coder.lattice.decode(r["ids"]) == r["text"] and not brute_spans(r["text"])
        assert brute_spans(whole[i]) or r["text"] == whole[i]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == docs.columns, name
