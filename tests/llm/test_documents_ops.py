"""Operators over documents against brute force on a table with all the awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from assayloom.llm import fingerprints, licenses, mixing, near_dup, packing, pii, quality, substrings, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, `key` string"


def corpus() -> list[tuple]:
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    a, shared = prose(120), prose(40)
    near = a.split()
    near[60] = "CHANGED"
    texts = [
        a, a, " ".join(near), None, "", " \n\t ", "one", "one two three", "One  two\nthree", prose(30) + "\n" + shared + " " + prose(20), shared + " x", prose(7) + " " + shared,
        prose(4000), "日本語 text with 数字 ١٢٣ 😀 " * 5, "Released under the MIT License. " + prose(30), prose(50) + " All Rights, Reserved! cc-by GENERAL public license", "w " * 40, a.upper(),
        "mail bob.x+y@ex-ample.co.uk, 10.0.0.255 and 999.1.1.1; card 4111 1111 1111 1111 or 4111-1111-1111-1112; call +1 (555) 010-2030 x", "ends <|endoftext|> here",
    ]
    rows = [(i * 3, t, "en", ["s1", "s2", None, "s10"][i % 4], i, 7, 0.5, "k") for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, prose(20), "en", "s1", 1, 7, 0.5, "k"), (None, None, None, None, None, None, None, None), (-5, shared, "de", "s2", 1, 7, 0.5, "k")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def vocabulary(name):
    return pytest.importorskip("public_tokenizers").path(name)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    for capacity, group, fan in ((64, 5, 2), (2048, 1 << 15, 8)):
        got = packing.pack(packing.tokenize_pieces(docs, path, "byte", capacity, 0, keep_ids=True), capacity, group_items=group, fan_in=fan).collect()
        want = {}
        for d, t, *_ in corpus():
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
            want.setdefault(d, []).append(ids)
        pieces = {}
        for x in got:
            ids = np.frombuffer(x["ids"], "<u4")
            assert len(ids) == x["length"] <= capacity and zlib.crc32(x["ids"]) == x["ids_crc32"]
            assert x["piece"] == 0 or x["length"] == capacity
            pieces.setdefault(x["doc_id"], []).append((x["piece"], x["start"], ids.tolist()))
        for d, all_ids in want.items():
            assert sorted(i for _, _, x in pieces[d] for i in x) == sorted(i for x in all_ids for i in x)
            if len(all_ids) == 1:
                done = sorted(pieces[d])
                assert [p for p, *_ in done] == list(range(len(done))) and sum((x for *_, x in done), []) == all_ids[0]
                assert [s for _, s, _ in done] == [0, *np.cumsum([len(x) for *_, x in done])[:-1].tolist()]
        bins = {}
        for x in got:
            bins.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
        for spans in bins.values():
            at = 0
            for o, n in sorted(spans):
                assert o == at
                at += n
            assert at <= capacity
        total = sum(x["length"] for x in got)
        assert len(bins) <= -(-total // capacity) * 1.35 + 3
    assert packing.pack(packing.tokenize_pieces(empty, path, "byte", 64, 0), 64).count() == 0


def test_sending_up_few_bins_needs_no_more_sequences_than_sending_all(spark):
    r = random.Random(31)
    for lengths in ([r.randint(1, 100) for _ in range(900)], [r.choice([34, 55, 60, 70]) for _ in range(700)], [r.randint(52, 80) for _ in range(500)], [5] * 333):
        df = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
        few, all_ = (packing.pack(df, 100, group_items=40, fan_in=3, carry_all=x).select("sequence_id").distinct().count() for x in (False, True))
        assert few <= all_ and few >= -(-sum(lengths) // 100)


def test_best_fit_is_tight():
    bins, offsets, fill = packing.best_fit([60, 50, 40, 30, 10, 10], 100)
    assert sorted(fill) == [100, 100] and len(set(zip(bins, offsets))) == 6


def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    token_files.write_token_files(docs, f"file://{tmp_path}/t", path, "word", 2, segment_bytes=600)
    got = token_files.read_token_files(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    rows = sorted(corpus(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    at, want = 0, []
    for d, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(g)[1] for g in got] == [w[1] for w in want] and sorted(map(tuple, ((g["doc_id"] or -99, g["n_tokens"], g["ids_crc32"]) for g in got))) == sorted((w[0] or -99, w[2], w[3]) for w in want)
    token_files.write_token_files(empty, f"file://{tmp_path}/e", path, "word", 2)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/e").count() == 0


def test_elias_fano_selects():
    r = np.random.default_rng(0)
    for values in ([0], [5], [0, 0, 0], [3, 1 << 63], np.sort(r.integers(0, 10**9, 3000)), np.sort(r.integers(0, 40, 500)), np.sort(r.integers(0, 1 << 62, 5)), np.concatenate([np.zeros(2000, int), [10**6]])):
        values = np.array(values, np.uint64)
        raw = token_files.ef_encode(values)
        ef = token_files.EliasFano(b"xy" + raw + b"z", 2)
        assert ef.end == 2 + len(raw) and ef.select(np.arange(len(values))).tolist() == values.tolist()
        pick = r.integers(0, len(values), 20)
        assert ef.select(pick).tolist() == values[pick].tolist()
    # near-minimal: 2 + log2(u / n) bits a value and the directory's sixteenth
    values = np.cumsum(r.integers(1, 2000, 100_000)).astype(np.uint64)
    assert len(token_files.ef_encode(values)) * 8 / len(values) <= 2 + np.log2(float(values[-1]) / len(values)) + 0.5
    assert token_files.EliasFano(token_files.ef_encode(np.zeros(0))).n == 0
    raw = token_files.encode_segment([None, -3, 4, (1 << 63) - 1], [np.array([1]), np.array([2, 3]), np.array([4]), np.array([], np.int64)], 2)
    s = token_files.Segment(raw)
    assert s.doc_ids(0, 4) == [None, -3, 4, (1 << 63) - 1] and s.doc_ids(2, 3) == [4] and s.document(1).tolist() == [2, 3] and s.document(3).tolist() == []
    low = token_files.Segment(token_files.encode_segment([-(1 << 63), (1 << 63) - 1], [np.array([1])] * 2, 4))
    assert low.doc_ids(0, 2) == [-(1 << 63), (1 << 63) - 1]
    with pytest.raises(ValueError):
        token_files.encode_segment([1], [np.array([70_000])], 2)


def test_reading_goes_through_select(spark, docs, tmp_path, monkeypatch):
    """A directory that is one off gives other offsets, so they do come from it."""
    path = vocabulary("word_bpe_49k.json")
    encode = token_files.encode_segment
    with monkeypatch.context() as m:
        m.setattr(token_files, "_BLOCK", 1)
        assert encode([1, 2], [np.array([1])] * 2, 2) != b""
        small = token_files.Segment(encode([1, 2, 3], [np.array([1] * 9)] * 3, 2))
        small.bounds.directory = small.bounds.directory + np.uint32(1)
        assert small.spans(0, 3)[1].tolist() != [9, 18, 27]
    token_files.write_token_files(docs, f"file://{tmp_path}/t", path, "word", 2, segment_bytes=600)
    whole, single = (token_files.read_token_files(spark, f"file://{tmp_path}/t", at_once=n).orderBy("start", "n_tokens").collect() for n in (4096, 1))
    assert whole == single


def test_fingerprints(docs, empty):
    got = fingerprints.edited_fingerprints(docs).collect()
    rows = sorted(corpus(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""), reverse=True)
    want = []
    for k, (d, t, *_) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), brute_winnow(t), brute_winnow(e)))
    key = lambda x: str(tuple(x))
    assert sorted(((g["doc_id"], g["n_chars"], g["edited_sha256"], g["fingerprint"], g["edited_fingerprint"]) for g in got), key=key) == sorted(want, key=key)
    for g in got:
        a, b = ({x[i : i + 8] for i in range(0, len(x), 8)} for x in (g["fingerprint"], g["edited_fingerprint"]))
        assert g["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert len(g["positions"]) == len(g["fingerprint"]) and len(g["edited_positions"]) == len(g["edited_fingerprint"])
    text = {d: t or "" for d, t, *_ in corpus()}
    for g in got:
        if g["doc_id"] is not None:
            t = text[g["doc_id"]]
            assert "".join(f"{brute_hash(t[p : p + fingerprints.K]):08x}" for p in (int(g["positions"][i : i + 8], 16) for i in range(0, len(g["positions"]), 8))) == g["fingerprint"]
    assert fingerprints.edited_fingerprints(empty).count() == 0
    assert fingerprints.edited_fingerprints(docs.where("doc_id = 3").limit(1)).first()["near_next"] == 1.0
    assert fingerprints.fingerprints(docs).count() == len(rows)


def brute_hash(gram: str, k=fingerprints.K) -> int:
    mask, h = (1 << 64) - 1, 0
    for c in (gram + "\0" * k)[:k]:
        h = (h * fingerprints._BASE + ord(c) + 1) & mask
    h ^= h >> 32
    return ((h * 0xD6E8FEB86659FD93) & mask) >> 32


def test_positions_lead_to_every_shared_passage():
    r = random.Random(21)
    for _ in range(60):
        word = lambda n: "".join(r.choice("abc ") for _ in range(n))
        shared = word(r.randint(15, 60))
        a, b = word(r.randint(0, 80)) + shared + word(r.randint(0, 80)), word(r.randint(0, 80)) + shared + word(40)
        got = fingerprints.passages(a, b)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in got)
        assert all(not (i and j and a[i - 1] == b[j - 1]) and not (i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]) for i, j, n in got)
        for i in range(len(a) - 14):
            for j in range(len(b) - 14):
                if a[i : i + 15] == b[j : j + 15]:
                    assert any(x <= i and y - x == j - i and i + 15 <= x + n for x, y, n in got)


def brute_winnow(t: str, k=fingerprints.K, w=fingerprints.W) -> str:
    """Windows one by one, with the module's rolling hash written out as a plain polynomial."""
    if not t:
        return ""
    mask, base = (1 << 64) - 1, fingerprints._BASE
    hashes = []
    for i in range(max(1, len(t) - k + 1)):
        h = 0
        for c in (t[i : i + k] + "\0" * k)[:k]:
            h = (h * base + ord(c) + 1) & mask
        h ^= h >> 32
        hashes.append(((h * 0xD6E8FEB86659FD93) & mask) >> 32)
    picked = []
    for i in range(max(1, len(hashes) - w + 1)):
        part = hashes[i : i + w]
        p = i + max(j for j, h in enumerate(part) if h == min(part))
        if not picked or picked[-1] != p:
            picked.append(p)
    return "".join(f"{hashes[p]:08x}" for p in picked)


def test_winnowing_guarantee():
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcd ") for _ in range(n))
    shared = word(fingerprints.K + fingerprints.W - 1)
    (a, _), (b, _) = fingerprints.winnow([word(300) + shared + word(100), word(50) + shared + word(400)])
    assert set(a.tolist()) & set(b.tolist())


def test_short_texts_share_a_hash_with_their_edited_text(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("abcdefghij ") for _ in range(n)) for n in range(22, 200)]
    got = fingerprints.edited_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts) and min(g["near_edited"] for g in got) > 0


def test_substrings(docs, empty):
    got = substrings.substring_dedup(docs, chunk_bytes=900, part_bytes=500, keep_text=True).collect()
    rows = [(d, WORD.findall(t or "")) for d, t, *_ in corpus()]
    first = {}
    for d, w in rows:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, float("inf")), float("inf") if d is None else d)
    want = []
    for d, w in rows:
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < (float("inf") if d is None else d) for j in range(i, i + 13)}
        want.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert sorted(map(str, ((g["doc_id"], g["n_words"], g["n_removed"], g["kept"]) for g in got))) == sorted(map(str, want))
    assert all(g["kept_sha256"] == hashlib.sha256(g["kept"].encode()).hexdigest() for g in got)
    assert sum(w[2] for w in want) > 100
    # each repeat is maximal: it is in a smaller document, and with the word before or after it is not in that one at that place
    words, again = dict(rows), 0
    for g in got:
        w = words[g["doc_id"]] if g["doc_id"] is not None else None
        for x in g["repeats"]:
            assert x["words"] >= 13
            if w is not None and g["n_words"] == len(w):
                s = w[x["start"] : x["start"] + x["words"]]
                places = [(d, i) for d, v in rows if d is not None and d < g["doc_id"] for i in range(len(v) - len(s) + 1) if v[i : i + len(s)] == s]
                again += bool(places)
                assert places
                d, i = min(places)
                v = words[d]
                assert not (x["start"] and i and w[x["start"] - 1] == v[i - 1]) and (x["start"] + len(s) == len(w) or i + len(s) == len(v) or w[x["start"] + len(s)] != v[i + len(s)])
    assert again > 3
    assert substrings.substring_dedup(empty).count() == 0


def test_repeats_are_checked_on_their_words(docs, monkeypatch):
    """A request whose words are others than those at its place is reported, which stops the run."""
    r = random.Random(2)
    rows = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40))) for i in range(6)]
    df = docs.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert substrings.substring_dedup(df).where("n_removed > 0").count() == 0
    chunks = substrings.materialize(substrings.freeze(df.coalesce(1), 1 << 20)).cache()
    number = chunks.first()["chunk"]
    request = lambda place, words, text: (number, place, words, substrings._digest([w.encode() for w in text.split()]))
    texts = " ".join(t or "" for _, t in sorted(((i, t) for i, t in rows), key=lambda x: [y["doc_id"] for y in df.coalesce(1).collect()].index(x[0])))
    all_words = texts.split()
    good, bad = request(5, 13, " ".join(all_words[5:18])), request(6, 13, "other words " * 6 + "x")
    asked = df.sparkSession.createDataFrame([good, good, bad], "far long, place long, words long, digest binary")
    assert [tuple(x) for x in substrings._check(asked, chunks).collect()] == [(number, 6, 13)]


def test_near_duplicates(docs, empty):
    for n in (4, 5):
        got = near_dup.near_duplicates(docs, n=n).collect()
        low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
        rows = []
        for d, t, *_ in corpus():
            w = WORD.findall((t or "").translate(low))
            rows.append((d, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())))
        top = {d: d for d, _ in rows if d is not None}

        def find(x):
            return x if top[x] == x else find(top[x])

        for (a, x), (b, y) in itertools.combinations([r for r in rows if r[0] is not None], 2):
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and find(a) != find(b):
                top[max(find(a), find(b))] = min(find(a), find(b))
        want = [(d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in rows]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert near_dup.near_duplicates(empty).count() == 0


def test_near_copies_in_one_large_group(spark):
    """A group whose members are alike by chains, over several blocks, beside many texts that share one passage."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        w[r.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    common = " ".join(f"c{i}" for i in range(12))
    rows += [(1000 + i, common + " " + " ".join(f"u{i}_{j}" for j in range(r.randint(5, 40)))) for i in range(150)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), n=4)
    sets = {d: {tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for d, t in rows}
    top = {d: d for d in sets}

    def find(x):
        return x if top[x] == x else find(top[x])

    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and find(a) != find(b):
            top[max(find(a), find(b))] = min(find(a), find(b))
    assert {x["doc_id"]: x["component_id"] for x in got.collect()} == {d: find(d) for d in sets}


def test_signature_blocks_find_all_rows_with_a_near_partner(spark):
    """Every pair within the distance has one owner among the buckets that it shares, and is found there in blocks."""
    r = np.random.default_rng(3)
    sigs = [[int(x) for x in np.arange(near_dup.SYMBOLS) + (r.random(near_dup.SYMBOLS) < 0.3) * (i + 100)] for i in range(40)]
    rows = []
    for v in range(near_dup.SYMBOLS):
        c, out = divmod(v, near_dup.SPAN)
        at = [near_dup.SPAN * c + k for k in range(near_dup.SPAN) if k != out]
        by = {}
        for i, s in enumerate(sigs):
            by.setdefault(tuple(s[k] for k in at), []).append(i)
        rows += [(v * 1000 + n, v, i, i, sigs[i]) for n, group in enumerate(by.values()) if len(group) > 1 for i in group]
    df = spark.createDataFrame(rows, "key long, variant int, rep long, comp long, sig array<int>")
    near = {(i, j) for i in range(40) for j in range(i) if sum(x != y for x, y in zip(sigs[i], sigs[j])) <= near_dup.FAR}
    got = near_dup._near_in_blocks(df, block=8).collect()
    assert near and {x["rep"] for x in got} == {i for p in near for i in p}
    units = {}
    for x in got:
        units.setdefault((x["key"], x["i"], x["j"]), set()).add(x["rep"])
    assert all(any({i, j} <= u for u in units.values()) for i, j in near)


def test_common_sizes():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 60, 30)).astype(np.uint64) for _ in range(25)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:9]]
    assert near_dup.common(sets[:9], sets, width=7).tolist() == want
    assert near_dup.common(sets[:2], [np.array([10**6], np.uint64)]).tolist() == [[0], [0]]


def test_mixing(docs, empty):
    got = mixing.mix(docs, block=16, piece_rows=4, keep=["key"]).collect()
    rows = [(d, s, len(WORD.findall(t or ""))) for d, t, _, s, *_ in corpus()]
    sources = sorted({s for _, s, _ in rows if s is not None}) + ([None] if any(s is None for _, s, _ in rows) else [])
    size = {s: sum(n for _, x, n in rows if x == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    target, capped = {}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in capped)
        free = [s for s in sources if s not in capped]
        target = {s: 3 * size[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in sources}
        over = {s for s in free if target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    taken = {}
    for g in got:
        s = next(x for x in sources if size[x] == g["source_size"])
        assert g["target"] == pytest.approx(target[s]) and 0 <= g["taken"] <= 3 * g["size"] and set(g.asDict()) >= {"key"}
        taken[s] = taken.get(s, 0) + g["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 0.5 for s in sources)
    again = mixing.mix(docs.repartition(5), block=16, piece_rows=4).collect()
    assert sorted(str((g["doc_id"], g["size"], g["taken"])) for g in got) == sorted(str((g["doc_id"], g["size"], g["taken"])) for g in again)
    assert mixing.mix(empty).count() == 0


def test_mixing_follows_the_schedule(spark):
    """Slots against golden-ratio points mapped one by one, and the order's shares of every stretch."""
    r = random.Random(14)
    rows = [(i, " ".join(["w"] * r.randint(0, 50)), r.choice(["a", "b", "b", "b", "c", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    block = 16
    got = mixing.mix(df, block=block, piece_rows=16, slots=True).collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    names = ["a", "b", "c", None]
    goal = {s: int(np.floor(next(g["target"] for g in got if source[g["doc_id"]] == s) + 0.5)) for s in names}
    total = sum(goal.values())
    edge = np.cumsum([goal[s] for s in names]) / total
    slots = {s: [] for s in names}
    for i in range(-(-total // block)):
        p = (i + 1) * mixing.PHI
        slots[names[int(np.searchsorted(edge, p - np.floor(p), side="right"))]].append(i)
    late = -(-total // block)
    for s in names:
        need = -(-goal[s] // block)
        slots[s] = slots[s][:need]
        while len(slots[s]) < need:
            slots[s].append(late)
            late += 1
    taken_by_slot = {}
    for s in names:
        own = sorted((hashlib.md5(f"0:{i}".encode()).hexdigest(), i) for i in size if source[i] == s)
        at, all_ = 0, sum(size[i] for _, i in own)
        for _, i in own:
            starts = [a for a in range(at, goal[s], all_)] if size[i] else []
            g = next(x for x in got if x["doc_id"] == i)
            assert (g["slots"] or []) == sorted(slots[s][a // block] for a in starts)
            assert g["first_slot"] == (min(g["slots"]) if starts else None)
            at += size[i]
        for r_, slot in enumerate(slots[s]):
            taken_by_slot[slot] = (s, min(block, goal[s] - r_ * block))
    for a in range(0, total // block - 40, 20):  # low discrepancy: each stretch has near its share
        for s in names:
            here = sum(taken_by_slot.get(x, (0, 0))[0] == s for x in range(a, a + 40))
            assert abs(here - 40 * goal[s] / total) <= 4


def test_mixing_plan_is_native(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_licenses(docs, empty):
    got = {str((g["doc_id"], g["n_words"])): g for g in licenses.license_scan(docs).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    for d, t, *_ in corpus():
        w = word.findall((t or "").translate(low))
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        g = got[str((d, len(w)))]
        assert (g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == (len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        labels, score = {x for _, x in at}, 1.0 if at else 0.0
        for label, texts in licenses.license_templates().items():
            for p in texts:
                v = word.findall(p.translate(low))
                size, tokens = len(v), set(v)
                for b in range(max(1, -(-(len(w) - size) // size))):
                    share = len(tokens & set(w[b * size : (b + 2) * size])) / len(tokens)
                    if share >= 0.9:
                        labels.add(label)
                        score = max(score, share)
        assert g["labels"] == ",".join(sorted(labels)) and g["score"] == pytest.approx(score)
    assert any("mit" in g["labels"].split(",") for g in got.values())
    matcher = licenses.Matcher({}, licenses.PHRASES, licenses.license_templates(), 0.9)
    filler = ["lorem", "ipsum", "dolor"] * 60
    for label, texts in licenses.license_templates().items():
        for p in texts:  # each template is found inside other words, with a few of its own missing
            v = licenses.words(p)
            assert label in matcher([x.encode() for x in filler] + v + [x.encode() for x in filler])[4]
            drop = set(list(dict.fromkeys(v))[: int(len(set(v)) * 0.1)])
            assert label in matcher([x.encode() for x in filler] + [x for x in v if x not in drop])[4]
            half = sorted(set(v))[: int(len(set(v)) * 0.5)]
            assert label not in matcher(half + [b"zz"] * 9)[4]
    assert licenses.license_scan(empty).count() == 0


def brute_pii(t: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_patterns_equal_the_plain_expressions():
    r = random.Random(8)
    for _ in range(4000):
        t = "".join(r.choice(["a", "B", "1", "23", "255", "256", "@", ".", "+", "-", " ", "%", "_", "(", ")", "4111111111111111", "é", "a@b.c", "1.2.3.4"]) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(t) == brute_pii(t), t


def test_pii(docs, empty):
    net = pii.fit(docs, steps=5)
    got = pii.find(docs.select("doc_id", "text", "key"), net).collect()
    want = {}
    for d, t, *_ in corpus():
        want.setdefault(d, []).append(brute_pii(t or ""))
    for g in got:
        base = next(b for b in want[g["doc_id"]] if hashlib.sha256(pii.written(b).encode()).hexdigest() == g["base_sha256"])
        assert [g[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == i for s in base) for i in range(4)]
        assert not base or set(pii.written(base).split(",")) <= set(g["spans"].split(","))
    clean = {g["doc_id"]: g["text"] for g in pii.redact(docs, net).where("doc_id = 54").collect()}
    assert "<email>" in clean[54] and "<card>" in clean[54] and "4111 1111" not in clean[54]
    assert pii.redact(docs, net).columns == docs.columns and pii.redact(docs, net).where("text is null").count() == docs.where("text is null").count()
    assert pii.find(empty, pii.fit(empty)).count() == 0


def test_network_adds_true_spans_that_no_pattern_matches():
    """Held-out written forms, beside other numbers, in texts longer than a window; without the network there is none of them."""
    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choice("abcdefghé") for _ in range(r.randint(2, 8))) for _ in range(n))
    write = pii.Writer(np.random.default_rng(1))
    got = [write.passage(prose(60)) for _ in range(500)]
    net = pii.train([t for t, _ in got], [s for _, s in got], steps=700)
    held = [pii.Writer(np.random.default_rng(100 + k)).passage(prose(150)) for k in range(120)]
    found = pii.all_spans(net, [t for t, _ in held])
    real = right = added = 0
    for (t, spans), base, every in zip(held, *found):
        assert set(base) <= set(every)
        extra, unmatched = set(every) - set(base), {s for s in spans if not any(s[0] < e and a < s[1] for a, e, _ in base)}
        real, added = real + len(unmatched), added + len(extra)
        right += sum(any(s[0] < e and a < s[1] and k == s[2] for a, e, k in unmatched) for s in extra)
    assert real > 150 and right >= 0.6 * real and right >= 0.85 * added


def test_windows_join_spans_and_do_not_depend_on_neighbours():
    assert [pii.windows(n) for n in (0, 1, pii.WINDOW, pii.WINDOW + 1)] == [[], [0], [0], [0, pii.STRIDE]]
    for n in (5, 700, 2000):
        cover = np.zeros(n, int)
        for a in pii.windows(n):
            cover[a : a + pii.WINDOW] += 1
        assert cover.min() >= 1
    net, r = pii.Tagger(seed=2), np.random.default_rng(0)
    net.p["off"][0] = 0.2
    texts = ["".join(r.choice(list("ab 1@.é日"), n)) for n in (1, 30, 511, 512, 513, 3000)] + [""]
    together = pii.model_spans(net, texts, 0.0)
    assert any(together) and [pii.model_spans(net, [t], 0.0)[0] for t in texts] == together


def test_search_equals_all_paths():
    """Viterbi and the marginals against every path of short windows."""
    r = np.random.default_rng(4)
    net = pii.Tagger()
    K, T, B = pii.TAGS, 3, 40
    net.p["move"] = r.normal(0, 1, (K, K))
    em = r.normal(0, 1.5, (T, K, B)).astype(np.float32)
    em[:, 0] += 2
    n = r.integers(1, T + 1, B)
    tags = net.decode(em, n)
    p, _, z = net.marginals(np.ascontiguousarray(em.transpose(0, 2, 1)), n)
    for b in range(B):
        paths = list(itertools.product(range(K), repeat=int(n[b])))
        score = np.array([sum(em[t, k, b] for t, k in enumerate(x)) + sum(net.p["move"][i, j] for i, j in zip(x, x[1:])) for x in paths])
        assert tuple(tags[: n[b], b]) == paths[int(score.argmax())]
        w = np.exp(score - score.max())
        assert z[b] == pytest.approx(score.max() + np.log(w.sum()), rel=1e-5)
        for t in range(n[b]):
            assert p[t, b, 0] == pytest.approx(sum(x for x, q in zip(w, paths) if q[t] == 0) / w.sum(), abs=1e-5)


def test_windows_left_out_of_the_search_hold_no_tag():
    """The bound against the search of all windows, whatever the moves cost; and most windows of plain "outside" are left out."""
    r = np.random.default_rng(6)
    net = pii.Tagger()
    shut = 0
    for k in range(60):
        T, B = 30, 50
        net.p["move"] = r.normal(0, 1 + k % 3, (pii.TAGS, pii.TAGS)).astype(np.float32)
        em = r.normal(0, 1.5, (T, pii.TAGS, B)).astype(np.float32)
        em[:, 0] += r.uniform(0, 16)
        n = np.sort(r.integers(1, T + 1, B))[::-1]
        tags = net.decode(em, n)
        some = ((tags > 0) & (np.arange(T)[:, None] < n)).any(axis=0)
        kept = np.isin(np.arange(B), net.open_windows(em, n))
        assert not (some & ~kept).any()
        shut += (~kept).sum()
    assert shut > 500


def test_forward_pass_equals_the_one_that_is_trained():
    net, r = pii.Tagger(seed=3), np.random.default_rng(0)
    x, n = pii._pack([r.integers(0, 130, k).astype(np.uint8) for k in (40, 33, 33, 7, 1)])
    both, _ = net._lstm(net.p["emb"][x], np.arange(len(x))[:, None] < n)
    want = np.concatenate([both[:, 0], both[::-1, 1]], axis=1).transpose(0, 2, 1) @ net.p["out"] + net.p["off"]
    got = net.emissions(x, n).transpose(0, 2, 1)
    assert all(np.allclose(got[:k, j], want[:k, j], atol=1e-5) for j, k in enumerate(n))


def test_tagger_gradient():
    net = pii.Tagger(dim=3, hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, n = pii._pack([pii._classes("ab 12@x.de"), pii._classes("hello 1")])
    y = np.zeros(x.shape, np.int64)
    y[3:9, 0] = 1
    y[5:7, 1] = 4
    g, _ = net.gradient(x, n, y)
    for k, v in g.items():
        at, e = np.unravel_index(np.abs(v).argmax(), v.shape), 1e-4
        was = net.p[k][at]
        net.p[k][at] = was + e
        up = net.gradient(x, n, y)[1]
        net.p[k][at] = was - e
        down = net.gradient(x, n, y)[1]
        net.p[k][at] = was
        assert v[at] == pytest.approx((up - down) / 2 / e, rel=1e-2)


def test_quality(spark, docs, empty):
    r = random.Random(6)
    good = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(60))
    bad = lambda: r.choice([lambda: good().upper().replace(" ", "!! "), lambda: " ".join(w + " " + w + " " + w for w in good().split()[:20]), lambda: good().replace(" ", "### ")])()
    rows = [(i, bad() if i % 4 == 0 else good(), int(i % 4 != 0)) for i in range(400)]
    d, y = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, quality int")
    net = quality.fit(d, y, steps=120)
    got = {g["doc_id"]: g for g in quality.score(d, net).collect()}
    assert all(g["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, g in got.items())
    right = [g["predicted"] == rows[i][2] for i, g in got.items() if g["held_out"]]
    assert sum(right) >= 0.95 * len(right)
    more = quality.score(docs, net)
    assert more.count() == docs.count() and more.where("score < 0 or score > 1 or score is null").count() == 0
    assert quality.score(empty, quality.fit(empty, y.limit(0))).count() == 0
    texts = [x[1] for x in rows[:40]]
    alone = np.concatenate([net.forward([t]) for t in texts])
    assert np.allclose(alone, net.forward(texts), atol=1e-5)


def test_forward_pass_equals_a_plain_one():
    """Filters applied position by position and chunk by chunk, against the batched pass; texts over several chunks included."""
    r = random.Random(12)
    net = quality.Net(3)
    net.p["out"] = np.random.default_rng(0).normal(size=net.p["out"].shape).astype(np.float32)
    texts = ["", "a", "héllo wörld", "abcdefgh" * 5, "x y " * 700, "".join(r.choice("abc é日\n") for _ in range(2500)), "to be or not to be, to be or not to be"]
    got = net.forward(texts)
    for t, g in zip(texts, got):
        raw = t.encode()
        b = raw + b"\0" * quality.K
        emb = net.p["emb"]
        plane = [float(any(i + 8 <= len(raw) and i >= lag and raw[i : i + 8] == raw[i - lag : i - lag + 8] for lag in quality._LAGS)) for i in range(len(b))]
        n, tops = max(1, len(raw) - quality.K + 1), []
        for a in range(0, n, quality.CHUNK):
            acts = []
            for i in range(a, min(n, a + quality.CHUNK)):
                x = np.concatenate([np.append(emb[b[i + j]], plane[i + j]) for j in range(quality.K)])
                acts.append(x @ net.p["conv"])
            tops.append(np.maximum(np.max(acts, axis=0) + net.p["bias"], 0))
        f = np.concatenate([np.mean(tops, axis=0), np.max(tops, axis=0)])
        assert g == pytest.approx(1 / (1 + np.exp(-(f @ net.p["out"] + net.p["off"][0]))), abs=1e-4), t[:20]


def test_quality_labels_that_disagree_take_no_part(spark):
    texts = {i: "good words here " * 5 if i % 2 else "BAD!! " * 9 for i in range(60)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)]
    y = spark.createDataFrame(labels, "doc_id long, quality int")
    mixed = y.union(spark.createDataFrame([(i, i % 2) for i in range(60)] + [(500, 0), (500, 1), (None, 1), (7, None), (8, 3)], "doc_id long, quality int")).repartition(3)
    more = d.union(spark.createDataFrame([(500, "x" * 70_000)], "doc_id long, text string"))
    a, b = quality.fit(d, y, steps=8), quality.fit(more, mixed, steps=8)
    assert all(np.array_equal(a.p[k], b.p[k]) for k in a.p)


def test_very_long_texts(spark):
    """A text of 30,000 words, its near copy and a short text through every operator over documents."""
    r = random.Random(17)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(30_000)]
    near = [*words[:15_000], "CHANGED", *words[15_001:], "mail", "x.y@example.org"]
    rows = [(1, " ".join(words), "a"), (2, " ".join(near), "b"), (3, "short text of some words", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)
    got = {x["doc_id"]: x for x in substrings.substring_dedup(df, chunk_bytes=1 << 16).collect()}
    assert (got[1]["n_removed"], got[2]["n_words"], got[2]["n_removed"]) == (0, 30_002, 29_999)
    assert [(x["start"], x["words"]) for x in got[2]["repeats"]] == [(0, 15_000), (15_001, 14_999)]
    assert {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}
    prints = {x["doc_id"]: x for x in fingerprints.edited_fingerprints(df).collect()}
    assert all(0.5 < prints[d]["near_edited"] < 1 for d in (1, 2)) and prints[2]["near_next"] > 0.99 and prints[1]["fingerprint"] == brute_winnow(rows[0][1])
    mixed = {x["doc_id"]: x for x in mixing.mix(df, slots=True).collect()}
    assert [mixed[d]["size"] for d in (1, 2, 3)] == [30_000, 30_002, 5] and all(x["taken"] <= 3 * x["size"] for x in mixed.values())
    scan = {x["doc_id"]: x for x in licenses.license_scan(df).collect()}
    assert scan[1]["n_words"] == 30_000 and scan[2]["labels"] == ""
    found = {x["doc_id"]: x for x in pii.find(df.select("doc_id", "text"), pii.Tagger()).collect()}
    assert [found[d]["n_email"] for d in (1, 2, 3)] == [0, 1, 0]
    assert quality.score(df, quality.Net()).where("score between 0 and 1").count() == 3
    from tokenizers import Tokenizer

    byte, word = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
    pieces = packing.pack(packing.tokenize_pieces(df, byte, "byte", 2048, 0, keep_ids=True), 2048).collect()
    ids = [i for x in sorted((x for x in pieces if x["doc_id"] == 2), key=lambda x: x["piece"]) for i in np.frombuffer(x["ids"], "<u4").tolist()]
    assert ids == [*Tokenizer.from_file(byte).encode(rows[1][1], add_special_tokens=False).ids, 0]
    with_files = f"{spark.conf.get('spark.checkpoint.dir')}/long_token_files"
    token_files.write_token_files(df, with_files, word, "word", 2)
    counts = [x["n_tokens"] for x in token_files.read_token_files(spark, with_files).orderBy("doc_id").collect()]
    assert counts == [len(Tokenizer.from_file(word).encode(t, add_special_tokens=False).ids) + 1 for _, t, _ in rows]


def test_extra_columns_with_clashing_names(docs):
    """Columns that operators make for themselves may be there already."""
    from pyspark.sql import functions as F

    more = docs.withColumns({c: F.lit("x") for c in ("kept", "component_id", "n_shingles", "taken", "target", "slot", "n_words", "labels", "fingerprint", "bucket", "copy", "piece", "start", "part", "seq", "payload", "held_out", "n_email", "spans", "_row", "digest", "sig")})
    n = docs.count()
    assert near_dup.near_duplicates(more).count() == n and mixing.mix(more).count() == n and substrings.substring_dedup(more).count() == n
    assert fingerprints.edited_fingerprints(more).count() == n and licenses.license_scan(more).count() == n and fingerprints.fingerprints(more).count() == n
    assert pii.find(more, pii.Tagger()).columns.count("n_email") == 1 and dict(quality.score(more, quality.Net()).dtypes)["held_out"] == "boolean"


def test_neighbouring_spans_of_one_kind_are_told_apart():
    assert pii._stretches(np.array([0, 1, 2, 1, 2, 2, 0, 4, 3, 6, 6, 5, 0])) == [(1, 3, 0), (3, 6, 0), (7, 8, 1), (8, 9, 1), (9, 11, 2), (11, 12, 2)]
    spans = [(0, 3, 2), (3, 5, 2), (6, 7, 2), (7, 9, 0)]
    assert pii._stretches(pii._tags(10, spans)) == spans and pii._stretches(pii._tags(4, [])) == [] and pii._stretches(np.zeros(0, int)) == []


def test_pack_keeps_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, 0, 30 + i % 50) for i in range(300)], "doc_id long, piece int, length long")
    more = df.withColumns({c: F.lit("x") for c in ("_row", "_g", "carried_fill", "sequence_id", "offset", "bin", "fill", "members", "_to", "_bin", "_shift", "_c0", "g")})
    for group in (1 << 15, 40):
        got, plain = packing.pack(more, 100, group_items=group), packing.pack(df, 100, group_items=group)
        assert sorted(got.columns) == sorted(more.columns) and dict(got.dtypes)["offset"] == "bigint" and got.where("_row = 'x' and carried_fill = 'x' and bin = 'x' and _c0 = 'x'").count() == 300
        cells = lambda d: sorted(map(tuple, d.select("doc_id", "length", "sequence_id", "offset").collect()))
        assert [x[:2] for x in cells(got)] == [x[:2] for x in cells(plain)] and len({x[2] for x in cells(got)}) == len({x[2] for x in cells(plain)})


def test_classifier_sample_is_bounded_in_bytes(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(quality, "train", lambda texts, y, **how: taken.append((texts, y)))
    d = spark.createDataFrame([(i, f"{i} " + "x" * (i * 10)) for i in range(60)] + [(3, "0"), (3, "zz")], "doc_id long, text string")
    y = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    quality.fit(d, y)
    whole = taken[-1][0]
    assert "0" in whole and "zz" not in whole and len(whole) == len(taken[-1][1]) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(60))
    quality.fit(d, y, most_bytes=2000)
    few = taken[-1][0]
    assert 2 < len(few) < len(whole) and sum(map(len, few)) <= 2000 and set(few) == set(sorted(whole, key=len)[: len(few)])
