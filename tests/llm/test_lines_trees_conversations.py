"""Line dedup, conversation repair and Merkle manifests against plain versions on tables with awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from assayloom.llm import conversations, lines, merkle, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# lines


def plain_lines(rows):
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        own, kept = (t or "").split("\n"), []
        for x in own:
            ids = held[key(x)]
            last = max((i for i in ids if i is not None), default=None)
            if len(key(x)) < 40 or len(ids) < 5 or d == last:
                kept.append(x)
        out.append((d, "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=repr)


def line_rows():
    r = random.Random(3)
    common = ["Ünder the common Line that many documents hold, indeed", "\t the  second COMMON line, which is longer than forty \x0b", "short common line", "x" * 39, "É" * 40]
    rows = []
    for i in range(60):
        own = [f"line {i} {j} of its own with enough letters in it to count" for j in range(r.randint(0, 4))]
        own += [r.choice([str.upper, str.lower, str])(x) if x.isascii() else x for x in r.sample(common, r.randint(0, 5))]
        r.shuffle(own)
        rows.append((i * 7 % 61, "\n".join(own)))
    rows += [(None, common[0]), (None, common[0] + "\n" + common[0]), (5, None), (6, ""), (7, "\n\n"), (8, " " + common[0] + "\r\n" + common[0] + "\n"), (99, common[1] + "\n" + "w " * 40_000), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("frequent", [1000, 3])
def test_line_dedup(spark, monkeypatch, frequent):
    monkeypatch.setattr(lines, "FREQUENT", frequent)  # with 3, some hashes go by the broadcast, others by the shuffle
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(x) for x in lines.line_dedup(df).select("doc_id", "text", "n_lines", "n_dropped").collect()]
    assert sorted(got, key=repr) == plain_lines(rows)
    assert sum(x[3] for x in got) > 50


def test_line_dedup_of_awkward_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.line_dedup(empty).count() == 0
    df = spark.createDataFrame(line_rows(), "doc_id long, text string")
    more = df.withColumns({c: F.lit("x") for c in ("_row", "_lines", "_at", "_doc", "_h", "n_lines", "_gone", "_c0", "Text2")})
    got = lines.line_dedup(more)
    assert got.columns == [*more.columns, "n_dropped"] and dict(got.dtypes)["n_lines"] == "bigint" and got.where("_row = 'x' and _h = 'x' and _c0 = 'x'").count() == df.count()
    # one line in all documents, and all lines in one document
    same = spark.createDataFrame([(i, "a line that stands in every one of the documents") for i in range(3000)], "doc_id long, text string")
    assert lines.line_dedup(same).where("n_dropped = 0").collect()[0]["doc_id"] == 2999 and lines.line_dedup(same).agg(F.sum("n_dropped")).first()[0] == 2999


def test_line_dedup_is_native(spark):
    plan = lines.line_dedup(spark.createDataFrame(line_rows(), "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions", plan)


# conversations


def plain_report(rows, noisy=True):
    """Every conversation's report; the repair by best-first search over whole label strings, without grammar tables."""
    out = []
    names = dict.fromkeys(r[0] for r in rows)
    say = lambda v: " " if v is None else str(v)
    for c in names:
        got = []
        for _, turn, role, text in (r for r in rows if r[0] == c):
            role, text = say(role), say(text)
            how = zlib.crc32(f"{say(c)}:{say(turn)}".encode()) % 20 if noisy else 9
            if how == 1:
                text = ""
            if how == 2:
                text = re.sub("[.!?]", "", text)
            if how == 4:
                role = "user"
            got += [(turn, role, text)] * {0: 0, 3: 2}.get(how, 1)
        got.sort(key=lambda x: (x[0] is not None, x[0], x[1], sha(x[2])))
        faults, seen = [], set()
        for _, role, text in got:
            solid = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faults.append(1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = [x[0] for x in got if x[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:]))
        # states are the role initials that came out; at most two insertions stand in a row
        best = {"": (0, "", ())}
        may = lambda s: re.fullmatch("s?(ua)*u?", s)

        def insert(best):
            for _ in range(2):
                for s, (w, labels, said) in list(best.items()):
                    for role in ("user", "assistant"):
                        if may(s + role[0]):
                            new = (w + 3, labels + "I", (*said, f"{role}:"))
                            p = short(s + role[0])
                            if p not in best or new[:2] < best[p][:2]:
                                best[p] = new
            return best

        # what may follow depends on the last initial only
        short = lambda s: s[-1:] if s[-1:] != "a" else "ua"
        for (_, role, text), f in zip(got, faults):
            now = {}
            for s, (w, labels, said) in insert(best).items():
                ways = [(s, 4, "D", ())]
                if f not in (1, 2):
                    more = 3 * (f == 3)
                    ways += [(s + x[:1], more + 3 * (how != "K"), how, (f"{x}:{text}",)) for how, x in (("K", role), ("R", "user"), ("R", "assistant")) if x[:1] in ("s", "u", "a") and x and may(s + x[:1])]
                for p, cost, label, line in ways:
                    p = p if label == "D" else short(p)
                    new = (w + cost, labels + label, (*said, *line))
                    if p not in now or new[:2] < now[p][:2]:
                        now[p] = new
            best = now
        w, labels, said = min(v for s, v in insert(best).items() if re.fullmatch("s?(ua)+|", s) or s == "ua") if got else (0, "", ())
        out.append((c, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, w, labels, sha("\n".join(said))))
    return sorted(out, key=repr)


def conversation_rows(seed, n, most):
    r = random.Random(seed)
    rows = []
    for c in [None, *range(n)]:
        for t in range(r.randint(1, most)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "sam"])
            text = r.choice(["Yes.", "No!", "what", "", " \n ", None, "Well. And then?", "tail. ", "日本。"]) if r.random() < 0.6 else f"text {r.randint(0, 9)}."
            rows.append((c, r.choice([t, t, t, None, t + 3]), role, text))
    return rows


_COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("noisy", [True, False])
def test_conversations(spark, noisy):
    rows = conversation_rows(8, 60, 9)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = sorted((tuple(x[c] for c in _COLUMNS) for x in conversations.report(df, noisy).collect()), key=repr)
    assert got == plain_report(rows, noisy)


def test_long_conversations_over_many_runs(spark):
    """Conversations of thousands of rows are dealt to runs on two levels and more; their repair is that of one piece."""
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "tool"]), r.choice([f"t{t}.", f"t{t}", "same."])) for c, n in ((1, 3000), (2, 2), (3, 700), (4, 70_000)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {x["conv_id"]: tuple(x[c] for c in _COLUMNS) for x in conversations.report(df).collect()}
    want = {x[0]: x for x in plain_report([x for x in rows if x[0] != 4])}
    assert {c: got[c] for c in want} == want
    last = got[4]
    kept = [x for x in last[7] if x != "I"]
    dropped = sum(zlib.crc32(f"4:{t}".encode()) % 20 == 0 for t in range(70_000))
    twice = sum(zlib.crc32(f"4:{t}".encode()) % 20 == 3 for t in range(70_000))
    assert len(kept) == 70_000 - dropped + twice and last[1] <= dropped


def test_summaries_join_like_whole_runs():
    """Sums of any parts give the states of the best path over the whole, whose labels are the parts' labels in a row."""
    r = random.Random(11)
    for _ in range(150):
        symbols = ["".join((r.choice(conversations.ROLES), r.choice(conversations.FAULTS))) for _ in range(r.randint(1, 14))]
        cuts = sorted(r.sample(range(1, len(symbols)), min(len(symbols) - 1, r.randint(0, 4))))
        parts = ["".join(symbols[a:b]) for a, b in zip([0, *cuts], [*cuts, len(symbols)])]
        whole = conversations.summary("".join(symbols))
        sums = [conversations.summary(p) for p in parts]
        total = sums[0]
        for x in sums[1:]:
            total = conversations.joined(total, x)
        assert total == whole
        cost, e = conversations.best_end(total)
        q = conversations.states_between(sums, conversations.START, e)
        labels = "".join(conversations.paths(p)[a][b][1] for p, a, b in zip(parts, q, q[1:]))
        assert labels == conversations.paths("".join(symbols))[conversations.START][e][1]
        # no two states are reached by labels of which one starts the other
        for row in conversations.paths("".join(symbols)):
            found = [x[1] for x in row if x]
            assert not any(a.startswith(b) or b.startswith(a) for a, b in itertools.combinations(found, 2))


def test_repaired_rows_follow_the_grammar(spark):
    rows = conversation_rows(2, 40, 12)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    edited, _ = conversations.align(conversations.damaged(df))
    said = {}
    for x in conversations.repaired(edited).orderBy("at", "part").collect():
        said.setdefault(x["conv_id"], []).append(x)
    assert said and all(re.fullmatch("s?(ua)+", "".join(x["role"][0] for x in c)) for c in said.values())
    report = {x["conv_id"]: x["repaired_sha256"] for x in conversations.report(df).collect()}
    assert all(report[c] == sha("\n".join(f"{x['role']}:{x['text']}" for x in v)) for c, v in said.items())


def test_conversations_of_awkward_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversations.report(spark.createDataFrame([], schema)).count() == 0
    # 30,000 equal rows, and one whose only row is dropped
    lost = next(i for i in range(10**6) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(-1, 7, "user", "Again.")] * 30_000 + [(lost, 0, "user", "Hm.")]
    more = spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in ("at", "run", "c", "h", "items", "first", "m", "cost", "audit", "labels", "before", "_row", "n")}).repartition(3)
    got = {x["conv_id"]: x for x in conversations.report(more).collect()}
    assert got[lost].asDict() == {"conv_id": lost, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": sha("")}
    assert got[-1]["duplicate"] >= 29_000 and got[-1]["duplicate"] + 1 == sum(x != "I" for x in got[-1]["audit"])


# manifests


def plain_manifest(rows, fanout=2):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, lang, s, n: sha("".join(map(part, (d, s, lang, n, t))))
    groups = {}
    for d, t, lang, s, n in rows:
        bad = d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0
        groups.setdefault(lang, []).append((d is not None, d, leaf(d, t, lang, s, n), leaf(d, t, lang, s, n + bad) if bad else leaf(d, t, lang, s, n)))

    def tree(hashes):
        """The root, and the siblings left and right of each leaf on its way up."""
        levels, proofs = [hashes], [[] for _ in hashes]
        while len(levels[-1]) > 1:
            now = levels[-1]
            for i, p in enumerate(proofs):
                at = i // fanout ** (len(levels) - 1)
                a = at // fanout * fanout
                p.append(("".join(now[a:at]), "".join(now[at + 1 : a + fanout])))
            levels.append([sha("".join(now[a : a + fanout])) for a in range(0, len(now), fanout)])
        return levels[-1][0], proofs

    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([x[2] for x in groups[g]]) for g in names if groups[g].sort(key=lambda x: (x[0], x[1] or 0, x[2])) is None}
    root, tops = tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for (_, d, h, used), proof in zip(groups[g], trees[g][1]):
            acc = used
            for a, b in [*proof, *top]:
                acc = sha(a + acc + b)
            out.append((d, h, trees[g][0], root, sha("".join(a + b for a, b in [*proof, *top])), acc, acc == root))
    return sorted(out, key=repr)


def doc_rows(n):
    r = random.Random(n)
    rows = [(i, r.choice(["a", "bé", "日本", None, ""]) + "" if (x := r.random()) < 0 else None if x < 0.1 else "text" * r.randint(0, 5) + "é日", r.choice(["en", "en", "en", "de", "é", "z", None]), r.choice(["s", None]), r.choice([1, 99, None])) for i in range(n)]
    return rows + [rows[3], rows[3], (None, "x", "en", "s", 1), (None, "y", "en", "s", 1), (None, None, None, None, None), (2**62, "w" * 100_000, "lone", "s", 3)]


@pytest.mark.parametrize(("n", "fanout", "span"), [(150, 2, 8), (150, 2, 2), (90, 3, 2), (700, 2, 3), (40, 5, 1)])
def test_manifest(spark, n, fanout, span):
    rows = doc_rows(n)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = merkle.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], fanout=fanout, span=span).drop("proof")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    # rows that agree have equal leaves, and their places among each other are free
    assert sorted((tuple(x) for x in got.collect()), key=repr) == plain_manifest(rows, fanout)
    assert got.where("not verified").count() > 0


def test_manifest_of_awkward_tables(spark):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    empty = spark.createDataFrame([], DOCS)
    assert merkle.manifest(empty, fields).count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, "x", "en", "s", 1)], DOCS), fields).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof"] == [] and one["proof_sha256"] == sha("")
    same = [(4, "x", "en", "s", 1)] * 2000
    more = spark.createDataFrame(same, DOCS).withColumns({c: F.lit("x") for c in ("t", "h", "i", "n", "id", "bad", "leaf", "root", "proof", "_row", "b", "levels")}).repartition(4)
    got = sorted((tuple(x) for x in merkle.manifest(more, fields).drop("proof").collect()), key=repr)
    assert got == plain_manifest(same)
    # names of its own may be fields, key and group
    odd = spark.createDataFrame([(i, f"x{i}", 1) for i in range(9)], "h long, t string, i long")
    assert merkle.manifest(odd, ["h", "t"], key="h", group="i", count="h").where("verified").count() == sum(zlib.crc32(str(i).encode()) % 7 != 0 for i in range(9))


def test_queries_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name in ("op11_lines", "op12_conversations", "op13_manifest"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
