"""Small tests of the operators for training data: brute force, round trips, and the defined results of odd inputs."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright.llm import defects as DF
from tonewright.llm import neighbours as N
from tonewright.llm import splits as SP
from tonewright.llm import truncation as TR
from tonewright.llm.folding import author_key
from tonewright.llm.mixing import allocate, mix_sources, owed
from tonewright.llm.splitting import split_oversized
from tonewright.llm.tokens import decode_corpus, encode_corpus, encoder, token_sizes, tokenizer_path
from tonewright.llm.topn import top_n_per_group
from tonewright.llm.truncation import find_truncated, truncation_rates

NAN, INF = float("nan"), float("inf")


def test_top_n_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["a", "b", None]), i, rng.choice([0.5, 0.5, 1.0, -0.0, 0.0, NAN, INF, None]), "x") for i in range(400)]
    df = spark.createDataFrame(rows, "g long, s string, id long, score double, place string").repartition(5)
    got = sorted((r["g"], r["s"], r["place"], r["id"]) for r in top_n_per_group(df, ["g", "s"], "score", "id", 3).collect())
    want = []
    good = [r for r in rows if r[0] is not None and r[1] is not None and r[3] is not None and np.isfinite(r[3])]
    for key in {(r[0], r[1]) for r in good}:
        group = sorted((r for r in good if (r[0], r[1]) == key), key=lambda r: (-r[3], r[2]))
        want += [(*key, i + 1, r[2]) for i, r in enumerate(group[:3])]
    assert got == sorted(want)
    assert top_n_per_group(df.limit(0), ["g"], "score", "id", 2).collect() == []


TEXTS = ["Привет, мир!", "", None, "a  b\n\n c\r\n", "don't  stop 'til", "<|endoftext|> x", "😀‍👩 ё", "слово" * 400, "x" * 3000, " ", "Привет, мир!", " \u00a0" * 50, "а" + "\u2003" * 70 + "б", "\u00a0".join("abcdefgh" * 3)]


@pytest.mark.parametrize("head", [1_000_000, 3])
def test_encoding_equals_the_tokenizer(spark, head):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "")], "doc_id long, text string, ids string")
    enc = encoder(tokenizer_path())
    out = encode_corpus(df, "doc_id", "text", head_words=head)
    got = sorted((r["doc_id"], list(r["ids"])) for r in out.collect())
    assert got == sorted([(i, enc.encode_ordinary(t or "")) for i, t in enumerate(TEXTS)] + [(0, enc.encode_ordinary(TEXTS[0]))])
    sizes = {r["doc_id"]: r["n_tokens"] for r in token_sizes(df.select("doc_id", "text"), "text", head_words=head).collect()}
    assert all(sizes[i] == len(enc.encode_ordinary(t or "")) for i, t in enumerate(TEXTS))
    if head > 3:
        odd = spark.createDataFrame([(0, None), (1, []), (2, [-1]), (3, [50_000_000]), (4, [None]), (5, [127, 235])], "doc_id long, ids array<int>")
        assert {r["doc_id"]: r["text"] for r in decode_corpus(odd, "doc_id", "ids").collect() if r["doc_id"] < 5} == {0: None, 1: "", 2: None, 3: None, 4: None}
        back = Counter((r["doc_id"], r["text"]) for r in decode_corpus(out, "doc_id", "ids").collect())
        assert back == Counter([(i, t or "") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0])])


def test_heads_of_many_corpora_are_kept_apart(spark):
    """One worker meets the heads of many short-lived corpora, of which none may answer for another."""
    import gc

    import pyarrow as pa

    from tonewright.llm.tokens import head_arrays, look_up

    for k in range(100):
        head = pa.table({"word": [f"w{k}", "x"], "ids": pa.array([[k], [k, k + 1]], pa.list_(pa.int32()))})
        words, starts, sizes, flat = head_arrays(head)
        assert words.to_pylist() == [f"w{k}", "x"] and flat.tolist() == [k, k, k + 1] and sizes.tolist() == [1, 2] and starts.tolist() == [0, 1]
        at, n, flat = look_up(pa.array([["x"]]), pa.nulls(1, pa.list_(pa.struct([("word", pa.string()), ("ids", pa.list_(pa.int32()))]))), head, tokenizer_path())
        assert flat[at[0] : at[0] + n[0]].tolist() == [k, k + 1]
        del head
        gc.collect()
    enc = encoder(tokenizer_path())
    for k in range(12):
        df = spark.createDataFrame([(i, f"слово{k} дом{i} {k}") for i in range(5)], "id long, text string").coalesce(1)
        assert all(list(r["ids"]) == enc.encode_ordinary(f"слово{k} дом{r['id']} {k}") for r in encode_corpus(df, "id", "text").collect())


def test_pieces(spark):
    rng = random.Random(2)
    words = ["кот", "пёс", "дом", "сад", "и", "свет"]
    long = "\n\n".join(" ".join(" ".join(rng.choice(words) for _ in range(9)).capitalize() + "." for _ in range(6)) for _ in range(5))
    texts = [long, "x" * 900, None, "", " " * 900, "коротко", "слово " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    limits = spark.createDataFrame([("a", 60, 8), ("b", 30, 0)], "setting string, max_tokens int, overlap_tokens int")
    enc, most = encoder(tokenizer_path()), {"a": 60, "b": 30}
    rows = split_oversized(df, limits, "id", "text").collect()
    for (setting, i), group in itertools.groupby(sorted(rows, key=lambda r: (r["setting"], r["id"], r["piece_no"])), key=lambda r: (r["setting"], r["id"])):
        at = 0
        for r in group:
            assert r["piece"] == texts[i][r["start"] : r["end"]] == r["piece"].strip()
            assert r["n_tokens"] == len(enc.encode_ordinary(r["piece"])) <= most[setting]
            assert r["start"] <= at or not texts[i][at : r["start"]].strip()
            at = r["end"]
        assert not texts[i][at:].strip()
    assert {r["id"] for r in rows} == {0, 1, 6}
    with pytest.raises(ValueError):
        split_oversized(df, spark.createDataFrame([("a", 0, 1)], limits.schema), "id", "text")


def test_pieces_keep_every_limit(spark):
    rng = random.Random(12)
    texts = ["преобразование" * 30, "😀👩\u200d🚀" * 40, "漢字かな" * 60, "x" * 300, "don't 'til 's's's " * 20, " ёлки-палки, " * 30, "а б в г д " * 30, "\n\n \t" * 50 + "конец" + " " * 90]
    texts += ["".join(rng.choice(["слово", " ", ". ", "\n", "’", "😀", "1234567", "—", "Ы"]) for _ in range(rng.randrange(80, 300))) for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    settings = [(f"{m}/{o}", m, o) for m in (4, 5, 7, 8, 13, 20, 32, 64) for o in (0, m // 4)]
    enc = encoder(tokenizer_path())
    rows = split_oversized(df, spark.createDataFrame(settings, "setting string, max_tokens int, overlap_tokens int"), "id", "text").collect()
    most = {s: m for s, m, _ in settings}
    groups = {}
    for r in sorted(rows, key=lambda r: r["piece_no"]):
        groups.setdefault((r["setting"], r["id"]), []).append(r)
    for (setting, i), pieces in groups.items():
        at = 0
        for k, r in enumerate(pieces):
            assert r["piece"] == texts[i][r["start"] : r["end"]] == r["piece"].strip() and r["piece_no"] == k + 1 and r["n_pieces"] == len(pieces)
            assert r["n_tokens"] == len(enc.encode_ordinary(r["piece"])) <= most[setting]
            assert r["end"] > at and (r["start"] <= at or not texts[i][at : r["start"]].strip())
            at = r["end"]
        assert not texts[i][at:].strip()
    assert set(groups) == {(s, i) for s, m, _ in settings for i, t in enumerate(texts) if len(enc.encode_ordinary(t)) > m}
    one = spark.createDataFrame([("one", 1, 0)], "setting string, max_tokens int, overlap_tokens int")
    plain = spark.createDataFrame([(0, "aa bb")], "id long, text string")
    assert all(r["n_tokens"] == 1 for r in split_oversized(plain, one, "id", "text").collect())
    with pytest.raises(Exception, match="more than 1 tokens"):
        split_oversized(df.filter("id = 2"), one, "id", "text").collect()


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, "слово " * rng.randrange(5, 60), "big" if i % 4 else "small") for i in range(400)] + [(900, None, "big"), (901, "", "big"), (902, "ничей", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "big", 0.5, 1, 0.4), ("m", "small", 0.4, 3, 0.4), ("m", "none", 0.1, 2, 0.4), ("tiny", "small", 1.0, 2, 5.0)], "mix_name string, source string, target_share double, max_repeats int, size_ratio double")
    mix, report = mix_sources(docs, targets, "doc_id", "text", "source")
    got = {(r["mix_name"], r["source"]): r for r in report.collect()}
    assert got["m", "none"]["tokens"] == 0 and got["tiny", "small"]["tokens"] == 2 * got["tiny", "small"]["available_tokens"]
    assert got["m", "big"]["share"] == pytest.approx(0.5 / 0.9, abs=0.02)
    copies = Counter()
    for r in mix.collect():
        assert r["n_tokens"] > 0 and r["copies"] <= {"big": 1, "small": 3}[r["source"]]
        copies[r["mix_name"], r["source"]] += r["n_tokens"] * r["copies"]
    assert all(copies[k] == r["tokens"] for k, r in got.items())
    again = mix_sources(docs.repartition(9), targets, "doc_id", "text", "source")[0]
    assert Counter(mix.collect()) == Counter(again.collect())
    shares = allocate([dict(mix_name="m", source="a", target_share=0.5, max_repeats=1, size_ratio=1.0), dict(mix_name="m", source="b", target_share=0.5, max_repeats=1, size_ratio=1.0)], {"a": 10, "b": 90}, 100)
    assert [s.tokens for s in shares] == [10, 90]


def test_copies_of_a_text_share_its_odds(spark):
    assert owed(30, {1: 20, 2: 20}, 1) == {1: 1.0, 2: 0.5} and owed(80, {1: 20, 2: 20}, 2) == {1: 2.0, 2: 2.0}
    assert owed(15, {1: 10, 4: 40}, 3) == {1: 0.75, 4: 0.1875}
    rows = [(i, f"слово {i} кот", "s") for i in range(800)] + [(1000 + i, f"повтор {i % 200} кот", "s") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([(f"m{k}", "s", 1.0, 1, 0.3) for k in range(6)], "mix_name string, source string, target_share double, max_repeats int, size_ratio double")
    mix, report = mix_sources(docs, targets, "doc_id", "text", "source")
    drawn = Counter((r["mix_name"], r["doc_id"] >= 1000) for r in mix.collect())
    once, often = (sum(n for (_, many), n in drawn.items() if many == m) / 4800 for m in (False, True))
    assert often / once == pytest.approx(0.25, abs=0.06) and once == pytest.approx(0.48, abs=0.05)
    assert all(abs(r["tokens"] - r["wanted_tokens"]) < 30 for r in report.collect())


def test_author_spellings():
    same = ["Сергей Кибагиденов", "Кибагиденов, Сергей", "СЕРГЕЙ КИБАГИДЕНОВ", "Сep​гeй Кибaгидeнoв", "<сергей_кибагиденов>", "Сергей Кибагиденов"]
    assert len({author_key(a) for a in same}) == 1
    assert author_key("Сергеи Кибагиденов") != author_key(same[0]) and author_key("kot1") != author_key("kot2") and author_key(" - ") == author_key(None) == ""


@pytest.mark.parametrize("hot", [256, 1])
def test_related_rows_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(SP, "HOT", hot)
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([8, 20, 24, 33]))] for _ in range(12)]
    texts = []
    for b in base:
        for edits in (0, 1, 2, 3):
            w = list(b)
            for _ in range(edits):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], ["new"], [w[k], "new"]])
            texts.append(w)
    shared = texts[0][:14]
    texts += [shared + [rng.choice(vocab) for _ in range(8)] for _ in range(6)]
    rows = [(i, rng.choice([f"a{i}", f"A{i}", None, f"b{i % 7}"]), " ".join(t)) for i, t in enumerate(texts)] + [(900, " ", None), (901, "q", ""), (902, None, None)]
    df = spark.createDataFrame(rows, "id long, author string, text string")
    got = {r["id"]: r["component"] for r in SP.relate(df, "id", "author", "text").collect()}
    parent = {i: i for i, *_ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a, t), (j, b, u) in itertools.combinations(rows, 2):
        x, y = (t or "").split(), (u or "").split()
        near = x and (x == y or (min(len(x), len(y)) >= 20 and SP.within(x, y)))
        if near or (author_key(a) and author_key(a) == author_key(b)):
            parent[find(i)] = find(j)
    for i, j in itertools.combinations(parent, 2):
        assert (find(i) == find(j)) == (got[i] == got[j]), (i, j)


def _templates(case):
    """Texts of one template that differ in few words, the smallest id first."""
    run = [f"t{i}" for i in range(18)]
    if case == "both ends":  # the first has a rest near to that of all others, and is near to none
        return [[*run, "x", "y", "z0"]] + [[f"p{i}", *run, "z0", f"q{i}"] for i in range(12)]
    if case == "longer run":
        return [[*run, *run[:3], "x", "y"]] + [[f"p{i}", *run, *run[:3], f"q{i}"] for i in range(12)]
    if case == "one or two":
        return [[*run, "e", f"a{i}"] for i in range(12)] + [[*run, "e", f"b{i}", f"c{i}"] for i in range(12)]
    if case == "two or four":  # the four of each hold the two, apart from one another
        return [[*run, "e", f"a{i}", f"b{i}"] for i in range(6)] + [[*run, "e", f"a{i}", f"c{i}", f"b{i}", f"d{i}"] for i in range(6)]


def _joined(spark, texts):
    """Components of ``texts`` by the operator and by brute force, as sets of sets of positions; single ones too."""
    ids = sorted({tuple(t): i for i, t in reversed(list(enumerate(texts)))}.items(), key=lambda x: x[1])
    df = spark.createDataFrame([(i, list(t)) for t, i in ids], "id long, words array<string>")
    links = [(r["a"], r["b"]) for r in SP.near_passages(df).collect()]
    near = [(i, j) for (t, i), (u, j) in itertools.combinations(ids, 2) if SP.within(list(t), list(u))]
    both = []
    for edges in (links, near):
        group = {i: {i} for _, i in ids}
        for a, b in edges:
            if group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
        both.append({frozenset(g) for g in group.values()})
    return both


@pytest.mark.parametrize("case, hot", [("both ends", 4), ("longer run", 1), ("one or two", 4), ("two or four", 2)])
def test_hot_templates_with_slots(spark, case, hot, monkeypatch):
    monkeypatch.setattr(SP, "HOT", hot)
    got, want = _joined(spark, _templates(case))
    assert got == want


def test_near_texts_share_a_key_and_are_alike():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(400):
        a = [rng.choice(vocab) for _ in range(rng.choice([20, 22, 40]))]
        b = list(a)
        for _ in range(2):
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice([[], ["new"], [b[k], rng.choice(vocab)], [rng.choice(vocab)]])
        texts += [a, b]
    codes = np.array([SP._code(w, {"w3": 900, "w4": 50}) for t in texts for w in t], dtype=np.uint64)
    sizes = np.array([len(t) for t in texts])
    keys, counts = SP.common_keys(codes, sizes), SP.counts_of(codes, sizes)
    assert all(set(keys[i]) & set(keys[i + 1]) for i in range(0, len(texts), 2))
    assert SP._alike(counts[::2], counts[1::2]).all() and not SP._alike(counts[:-2], counts[2:]).all()


def test_only_candidates_carry_their_words(spark, monkeypatch):
    rng = random.Random(9)
    texts = [[f"w{rng.randrange(3000)}" for _ in range(25)] for _ in range(300)]
    texts[1] = [*texts[0][:-1], "other"]
    df = spark.createDataFrame([(i, f"a{i}", " ".join(t)) for i, t in enumerate(texts)], "id long, author string, text string")
    met = []
    monkeypatch.setattr(SP, "near_passages", lambda p: met.append(p.count()) or spark.createDataFrame([], "a long, b long"))
    got = {r["id"]: r["component"] for r in SP.relate(df, "id", "author", "text").collect()}
    assert not met and got[0] == got[1] and len(set(got.values())) == 299


def test_splits_keep_groups_and_shares(spark):
    rows = [(i, f"author{i % 60}" if i % 3 else "Hot", f"text {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, author string, text string")
    out = {r["id"]: r["split"] for r in SP.assign_splits(df, "id", "author", "text").collect()}
    per = {}
    for i, a, _ in rows:
        per.setdefault(a, set()).add(out[i])
    assert all(len(s) == 1 for s in per.values()) and len(out) == 600
    counts = Counter(out.values())
    assert abs(counts["train"] / 600 - 0.8) < 0.03 and counts["test"] > 40
    assert SP.assign_splits(df.limit(0), "id", "author", "text").collect() == []


def test_differencing_balances():
    rng = np.random.default_rng(5)
    w = rng.integers(1, 100, 300)
    place = [p[0] for p in SP.difference([(x,) for x in w], 10)]
    sums = np.bincount(place, weights=w, minlength=10)
    assert sums.max() - sums.min() <= 3 and sums.sum() == w.sum()


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 16))
    x = (centres[:, None] + 0.15 * rng.normal(size=(60, 8, 16))).reshape(-1, 16)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [NAN] * 16), (903, [1.0]), (904, (15 * x[0]).tolist())]
    v = N.unit_vectors(spark.createDataFrame(rows, "id long, e array<double>"), "id", "e", 16)
    usable = [(i, np.array(e)) for i, e in rows if e is not None and len(e) == 16 and np.isfinite(e).all() and np.any(e)]
    ids = np.array([i for i, _ in usable])
    u = np.stack([e / np.linalg.norm(e) for _, e in usable])
    c = u @ u.T
    want = {(min(a, b), max(a, b)) for a, b in zip(*np.nonzero(c >= 0.9)) if a < b}
    want = {(ids[a], ids[b]) for a, b in want}
    for block, part, sample in ((8192, 1 << 16, 1 << 16), (7, 5, 64)):
        monkeypatch.setattr(N, "BLOCK", block)
        monkeypatch.setattr(N, "PART", part)
        monkeypatch.setattr(N, "SAMPLE", sample)  # the deeper levels are fitted by aggregation
        got = {(r["a"], r["b"]) for r in N.similar_pairs(v, 16, 0.9, trees=8, visits=20, leaf=32).collect()}
        assert got <= want and len(got) >= 0.97 * len(want) and (0, 904) in got
        asking = v.withColumn("asks", F.col("id") % 50 == 0)
        for options in ({"exact": True}, {"recall": 0.97, "leaf": 32}):
            near = N.nearest(asking, 16, 5, "asks", trees=4, **options).collect()
            true = set()
            for i in ids[ids % 50 == 0]:
                row = c[np.flatnonzero(ids == i)[0]]
                order = sorted((j for j in range(len(ids)) if ids[j] != i), key=lambda j: (-round(row[j], 6), ids[j]))
                true |= {(i, ids[j]) for j in order[:5]}
            hits = {(r["id"], r["neighbour"]) for r in near} & true
            assert len(near) == len(true) and sorted(r["place"] for r in near) == sorted(list(range(1, 6)) * (len(true) // 5))
            assert len(hits) == len(true) if "exact" in options else len(hits) >= 0.9 * len(true)
    assert N.similar_pairs(v.limit(0), 16, 0.9).collect() == [] and N.nearest(asking.limit(0), 16, 3, "asks").collect() == []


def test_the_queue_gives_the_leaves_of_the_smallest_margins():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 6)).astype(np.float32)
    f = N.fit(x, 3, 4, 1)
    for row in x[:20]:
        cost = []
        for t in range(3):
            m = f.directions[t] @ row
            for leaf in range(16):
                node, worst = 0, -1.0
                for d in range(4):
                    bit = leaf >> (3 - d) & 1
                    gap = m[d] - f.thresholds[t, (1 << d) - 1 + node]
                    if bit != (gap >= 0):
                        worst = max(worst, abs(gap))
                    node = 2 * node + bit
                cost.append((worst, t * 16 + leaf))
        by_leaf = {leaf: worst for worst, leaf in cost}
        met = f.visits(row[None], 11)[0].tolist()
        assert len(set(met)) == 11 and np.allclose([by_leaf[x] for x in met], sorted(by_leaf.values())[:11])


NAMES = ["Анна", "Пётр", "Ольга", "Иван", "Мария", "Олег"]
THINGS = ["красную лодку", "старый самовар", "тихую скрипку", "новый билет", "медную монету", "узкий шкаф"]
PLACES = ["на тёмном складе", "в старом парке", "на новой улице", "в тихом селе"]


def _stories(n, seed):
    rng = random.Random(seed)
    story = lambda: f"{rng.choice(NAMES)} {rng.choice(['показала', 'открыла', 'нашла', 'купила'])} {rng.choice(THINGS)} {rng.choice(PLACES)}"
    return [". ".join(["Вот что это было", *(story() for _ in range(3))]) + "." for _ in range(n)]


def test_truncation(spark):
    whole = _stories(300, 7)
    rows = [(i, t, None) for i, t in enumerate(whole)]
    rows += [(1000 + i, t[: len(t) - 7].rstrip() + m, "s") for i, (t, m) in enumerate(zip(whole[:12], itertools.cycle(["", "…", "<…>", " [...]"])))]
    rows += [(2000 + i, t[:-1], "s") for i, t in enumerate(whole[20:30])] + [(3000, None, "s"), (3001, "", "s"), (3002, " … ", "s")]
    df = spark.createDataFrame(rows, "row_id long, text string, source string")
    found = find_truncated(df, "row_id", {"text": "source"})
    got = {r["row_id"] for r in found.collect()}
    assert {i for i in got if i < 1000 or i >= 2000} == set() and len(got) == 12
    rates = {r["source"]: (r["n_values"], r["n_cut"]) for r in truncation_rates(df, "row_id", {"text": "source"}, found).collect()}
    assert rates == {None: (300, 0), "s": (23, 12)}
    assert find_truncated(df.limit(0), "row_id", {"text": "source"}).collect() == []


def test_signatures_are_counted_over_all_values(spark):
    """Four values in 60,000 show that an open end stands inside sentences only."""
    rows = [(i, f"Кот номер {i} спит.") for i in range(60_000)]
    rows += [(70_000 + i, f"Зелёный кувшин упал у {x} с полки. Дом стоит.") for i, x in enumerate(["Анны", "Ольги", "Олега", "Ивана"])]
    rows += [(80_000, "Вот дом. Зелёный кувшин упал"), (80_001, "Вот дом. Кот спит")]
    df = spark.createDataFrame(rows, "row_id long, text string").withColumn("source", F.lit("s")).repartition(4)
    assert [r["row_id"] for r in find_truncated(df, "row_id", {"text": "source"}).collect()] == [80_000]


@pytest.mark.parametrize("parts", ["1", "8"])
def test_marks_do_not_hide_the_longer_copy(spark, parts):
    """Values cut at the same place with several marks stand between each other and their longer copy."""
    tails = ["..", "...", "…", "<…>", " [...]", "", " вечером. Дом стоит."]
    rows = [(k, f"Слон любит купаться{tail}") for k, tail in enumerate(tails)]
    df = spark.createDataFrame(rows, "row_id long, text string").withColumn("source", F.lit("s"))
    shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for key, value in (("spark.sql.shuffle.partitions", parts), ("spark.sql.adaptive.enabled", "false")):
            spark.conf.set(key, value)
        got = sorted(r["row_id"] for r in find_truncated(df, "row_id", {"text": "source"}).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == list(range(6))


def test_counts_equal_single_signatures():
    rng = random.Random(8)
    texts = [[rng.choice(["и", "кот", "спит", "зелёный", "полка", "7"]) for _ in range(rng.randrange(1, 20))] for _ in range(50)]
    counts, classes = TR._Counts(np.full(1 << TR.MAP_BITS - 6, ~np.uint64(0))), TR._Classes()
    ends, inside = Counter(), Counter()
    for words in texts:
        counts.add([counts.words[w] for w in words])
        forms = [w.translate(TR._TABLE) for w in words]
        for i in range(len(words)):
            (ends if i == len(words) - 1 else inside).update(TR.signatures(forms, i, classes))
    key, e, i = counts.take()
    assert {k % (1 << 64): (a, b) for k, a, b in zip(key.tolist(), e.tolist(), i.tolist())} == {k: (ends[k], inside[k]) for k in ends.keys() | inside.keys()}


def test_pair_checks():
    lexicon = DF.Lexicon(DF.fit_languages([]))
    text = "Один два три четыре пять шесть семь восемь девять десять"
    answers = ["<news> ОДИН ДВА три: четыре пять шесть семь восемь девять новый", "Один два три четыре пять шесть семь восемь", None, "", "Ἐν ἀρχῇ ἦν ὁ λόγος καὶ ὁ λόγος ἦν πρὸς τὸν θεόν", text]
    f = DF.features([text] * 5 + [None], answers, lexicon)
    assert f.copy.tolist() == [True, False, False, False, False, False] and f.nothing.tolist() == [False, False, True, True, False, False]
    assert f.foreign[4] and not f.foreign[5] and len(f.grams()) == 6 and f.pair.shape == (6, len(DF.PAIR))
    one = DF.features([text], answers[:1], lexicon)
    assert np.array_equal(one.pair[0], f.pair[0]) and np.array_equal(one.places, f.grams()[0])
    assert all(map(DF.is_empty, [None, "", " \n", "—", "N/A", "<s></s>", "[]", "нет ответа", "​"])) and not DF.is_empty("Нет, ответа он не дал.")
    for a, b, d in (("abc", "abd", 1), ("abc", "bc", 1), ("abcd", "badc", 3)):
        assert DF.distance_within(list(a), list(b), d) and not DF.distance_within(list(a), list(b), d - 1)


def test_distance_brute_force():
    rng = random.Random(11)

    def whole(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j - 1] + (x != y), old[j] + 1, row[-1] + 1))
        return row[-1]

    for _ in range(600):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        d = whole(a, b)
        assert [DF.distance_within(a, b, k) for k in range(10)] == [d <= k for k in range(10)], (a, b)
    long = [str(i) for i in range(30_000)]
    assert DF.distance_within(long, [*long[:7], "x", *long[8:20_000], *long[20_001:]], 3000)


def test_defects_of_odd_tables(spark):
    schema = "row_id long, text string, styled_text string, value string, id string, answer string"
    fields = {"text": "value", "styled_text": "id"}
    empty = spark.createDataFrame([], schema)
    assert DF.find_defects(empty, "row_id", "text", "styled_text", fields).collect() == []
    few = spark.createDataFrame([(1, None, None, "v", "i", "a"), (1, None, None, "v", "i", "a"), (None, "Дом стоит.", "", "v", None, None), (3, " ", "слово " * 30_000, None, None, None)], schema)
    got = sorted((r["row_id"] or 0, r["defect"]) for r in DF.find_defects(few, "row_id", "text", "styled_text", fields).collect())
    assert got == [(0, "empty"), (1, "empty"), (1, "empty")]
    assert find_truncated(few, "row_id", fields).count() <= 1


def test_defects(spark):
    texts, answers = _stories(400, 8), _stories(400, 9)
    english = "The old man was in the house and he did not see her. She said that it was late and they had to go."
    rows = [(i, t, a) for i, (t, a) in enumerate(zip(texts, answers))] + [(400 + i, t, english) for i, t in enumerate(texts[:20])]
    rows += [(1000, texts[0], None), (1001, texts[0], " "), (1002, texts[1], texts[1].upper()), (1003, texts[2], "К сожалению, я не могу переписать этот текст."), (1004, None, "Иван нашла новый билет в тихом селе."), (1005, texts[3], english)]
    df = spark.createDataFrame(rows, "row_id long, text string, styled_text string").withColumn("m", F.lit("m"))
    got = {r["row_id"]: r["defect"] for r in DF.find_defects(df, "row_id", "text", "styled_text", {"text": "m", "styled_text": "m"}).collect()}
    want = {1000: "empty", 1001: "empty", 1002: "copy", 1003: "refusal", 1005: "other_language"}
    assert {k: got.get(k) for k in want} == want and 1004 not in got and not [k for k in got if k < 400]
    assert all(got[k] == "other_language" for k in range(400, 420))
