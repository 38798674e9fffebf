"""Operators 11 to 13 against brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcquarry.llm import conversation_repair, conversation_trie, fingerprints, queries, sequences

CLASHING = ("hi", "n", "c", "_q", "position", "depth", "digest", "label", "copy", "first", "cut", "_t")
MESSAGES = "conv_id long, turn long, role string, text string"


def rows_of(spark, sf, table="conversations"):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{table}.parquet").collect()]


def in_order(rows):
    """Turns of each conversation: nulls first, then role and text."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        out[c].append((turn is not None, turn or 0, role, text))
    return {c: [(t[1] if t[0] else None, *t[2:]) for t in sorted(v)] for c, v in out.items()}


def awkward_conversations(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", None, ""]), r.choice(["Yes.", "no", " ", "", None, "Go! ", "ß?"])) for c in range(40) for t in range(r.randint(0, 6))]
    rows += [(7, None, "user", "first?"), (7, None, None, None), (7, 3, "user", "tie."), (7, 3, "user", "tie."), (None, 1, "user", "lost."), (None, None, None, None), (8, 2, "user", "long. " * 50_000)]
    rows += [(100 + c, t, "user", "same.") for c in range(30) for t in range(5)]
    return rows, spark.createDataFrame(rows, MESSAGES).withColumns({c: F.lit(1) for c in CLASHING})


# positions


def test_running_over_partitions(spark):
    r = random.Random(1)
    rows = [(k, i, r.getrandbits(63)) for k, n in ((1, 3), (2, 20_000), (3, 1), (None, 700), (9, 5_000)) for i in range(n)]
    want, xor = {}, defaultdict(int)
    for k, i, v in rows:
        xor[k] ^= v
        want[k, i] = (i + 1, xor[k])
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = sequences.running(df, "k", [F.col("i")], ["k", "i", "v"], {"x": "v"}, "t").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {(g.k, g.i): (g.position, g.x) for g in got} == want and len(got) == len(rows)


# 11: prefix trie


def brute_trie(rows):
    own = {c: [(role or "", text or "") for _, role, text in v] for c, v in in_order([(c, t, r or "", x or "") for c, t, r, x in rows if c is not None]).items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_rows(df):
    return sorted(tuple(r[c] for c in TRIE) for r in df.collect())


def test_trie_query(spark, sf):
    assert trie_rows(queries.op11_prefix_trie(spark, sf)) == brute_trie(rows_of(spark, sf))


@pytest.mark.parametrize("shard_rows, band_rows", [(1 << 18, 1 << 20), (12, 1 << 20), (12, 5), (1, 1)])
def test_trie_awkward(spark, shard_rows, band_rows):
    rows, df = awkward_conversations(spark)
    assert trie_rows(conversation_trie.borrowed_heads_trie(df, shard_rows, band_rows)) == brute_trie(rows)


def test_trie_empty(spark):
    assert conversation_trie.borrowed_heads_trie(spark.createDataFrame([], MESSAGES)).collect() == []


def test_louds_round_trip():
    r = np.random.default_rng(4)
    for n in (1, 2, 50, 400):
        parents = np.sort(np.array([r.integers(-1, i) for i in range(n)]))
        t = conversation_trie.Louds(parents)
        assert np.array_equal(t.parents(), parents)
        assert np.array_equal(t.degrees(), np.bincount(parents + 1, minlength=n + 1))
        assert t.levels()[-1][1] == n and all(a < b for a, b in t.levels())


# 12: fingerprints


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_edits(rows):
    rows = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    return [(r[1] if r[0] else None, r[2], r[2][: len(r[2]) - len(r[2]) // 4] + nxt[2][: len(r[2]) // 4], nxt[2]) for r, nxt in zip(rows, rows[1:] + rows[:1])]


def assert_fingerprints(got, rows):
    want = brute_edits(rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_chars, r.edited_sha256) for r in got) == sorted((i if i is not None else -1, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in want)
    one = {(i, len(t), hashlib.sha256(e.encode()).hexdigest()): (t, e, n) for i, t, e, n in want}
    prints, errors = {}, []
    for r in got:
        t, e, n = one[r.doc_id, r.n_chars, r.edited_sha256]
        for text, f in ((t, r.fingerprint), (e, r.edited_fingerprint)):
            assert prints.setdefault(text, f) == f and len(f) == (256 if shingles(text) else 0)
        errors += [r.near_edited - jaccard(shingles(t), shingles(e)), r.near_next - jaccard(shingles(t), shingles(n))]
    errors = np.abs(errors)
    assert errors.max() < 0.16 and errors.mean() < 0.03


def test_edited_fingerprints_are_those_of_the_edited_texts(spark):
    r = random.Random(15)
    texts = ["".join(r.choice(["a", "bb", "ç", " ", " ", "\n", " \t "]) for _ in range(r.randint(0, 90))) for _ in range(700)]
    rows = list(enumerate(texts))
    got = {x.doc_id: x.edited_fingerprint for x in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    edits = spark.createDataFrame([(i, e) for i, _, e, _ in brute_edits(rows)], "doc_id long, text string")
    want = fingerprints.fingerprint_of(edits, "text", "f").select("doc_id", fingerprints.written("f").alias("f"))
    assert got == {x.doc_id: x.f for x in want.collect()}


def test_fingerprint_query(spark, sf):
    rows = [(r[0], r[1]) for r in rows_of(spark, sf, "documents")]
    assert_fingerprints(queries.op12_fingerprints(spark, sf).collect(), rows)


def test_fingerprints_awkward(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choices(words, k=r.randint(0, 400))) for _ in range(1500)]
    rows = [(i * i * 7919 - 50, t) for i, t in enumerate(texts)] + [(None, "no id " * 9), (None, None), (7, None), (8, ""), (8, " \n"), (9, "one two"), (9, "one two"), (2**62, "long text 😀 " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({c: F.lit(1) for c in CLASHING})
    assert_fingerprints(fingerprints.fingerprints(df).collect(), rows)
    assert fingerprints.fingerprints(df.limit(0)).collect() == []
    alone = fingerprints.fingerprints(df.where("doc_id = 7")).first()
    assert (alone.n_chars, alone.fingerprint, alone.near_edited, alone.near_next) == (0, "", 1.0, 1.0)


def test_densification_fills_and_agrees(spark):
    """Sets with few shingles: the estimate stays close although nearly all bins borrow."""
    r = random.Random(6)
    rows = []
    for i in range(400):
        words = [f"a{r.random()}" for _ in range(r.randint(5, 60))]
        other = words[: len(words) - r.randint(0, len(words) // 2)] + [f"b{r.random()}" for _ in range(r.randint(0, 9))]
        rows.append((" ".join(words), " ".join(other)))
    df = spark.createDataFrame(rows, "a string, b string")
    df = fingerprints.fingerprint_of(fingerprints.fingerprint_of(df, "a", "f"), "b", "g")
    errors = [x.near - jaccard(shingles(x.a), shingles(x.b)) for x in df.select("a", "b", fingerprints.likeness("f", "g").alias("near")).collect()]
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.12


# 13: structure repair


def all_audits(turns):
    """Least (cost, audit, roles) by trying every edit string; turns are (initial, must go, truncated)."""
    best = None
    n = len(turns)
    for runs in itertools.product(range(3), repeat=n + 1):
        if sum(runs) > 3:
            continue
        for acts in itertools.product("DKR", repeat=n):
            cost, state, audit, ok = 5 * sum(runs), "", "", True
            for k in range(n + 1):
                for _ in range(runs[k]):
                    state += "a" if state.endswith("u") else "u"
                    audit += "I"
                if k == n:
                    break
                initial, gone, cut = turns[k]
                audit += acts[k]
                if acts[k] == "D":
                    cost += 2
                elif gone:
                    ok = False
                elif acts[k] == "K":
                    cost += 5 * cut
                    state += initial or "?"
                else:
                    cost += 1 + 5 * cut
                    state += "a" if state.endswith("u") else "u"
            if ok and re.fullmatch("(s?(ua)+)?", state) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_ranks_find_least_audit():
    r = random.Random(7)
    layers = conversation_repair.Layers()
    for _ in range(250):
        turns = [(r.choice("suat"), r.random() < 0.15, r.random() < 0.2) for _ in range(r.randint(0, 4))]
        turns = [(i, g, c and not g) for i, g, c in turns]
        codes = np.array(["suat".index(i) + 4 * g + 8 * c for i, g, c in turns], np.int32)
        cost, chosen, _, n, _ = layers.repair(codes)
        assert (cost, "".join(conversation_repair.CODES[c] for c in chosen) + "I" * n) == all_audits(turns)


def strings_dp(turns):
    """The same DP with whole audits and results in every state; turns are (role, text, must go, truncated)."""
    state = {"": (0, "", [])}
    after = lambda s, i: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((s, i))

    def relax(into, s, new):
        if s not in into or new[:2] < into[s][:2]:
            into[s] = new

    def inserts(states):
        out, level = dict(states), dict(states)
        for _ in range(3):
            following = {}
            for s, (cost, audit, made) in level.items():
                role = "assistant" if s == "u" else "user"
                relax(following, role[0], (cost + 5, audit + "I", made + [(role, "")]))
            for s, x in following.items():
                relax(out, s, x)
            level = following
        return out

    for role, text, gone, cut in turns:
        new = {}
        for s, (cost, audit, made) in inserts(state).items():
            relax(new, s, (cost + 2, audit + "D", made))
            if not gone:
                if after(s, role[:1]):
                    relax(new, after(s, role[:1]), (cost + 5 * cut, audit + "K", made + [(role, text)]))
                to = "assistant" if s == "u" else "user"
                relax(new, to[0], (cost + 1 + 5 * cut, audit + "R", made + [(to, text)]))
        state = new
    return min(x for s, x in inserts(state).items() if s in ("", "a"))


def brute_repair(rows):
    ids = {r[0] for r in rows}
    broken = []
    for c, turn, role, text in rows:
        one = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{one(c)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        broken += [(c, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    by = in_order(broken)
    out = []
    for c in ids:
        turns, seen, classed = by.get(c, []), set(), []
        n = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            classed.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, made = strings_dp(classed)
        out.append((c, gaps, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()))
    return sorted(out, key=repr)


REPAIR = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_rows(df):
    return sorted((tuple(r[c] for c in REPAIR) for r in df.collect()), key=repr)


def test_repair_query(spark, sf):
    assert repair_rows(queries.op13_structure_repair(spark, sf)) == brute_repair(rows_of(spark, sf))


def test_repair_awkward(spark):
    rows, df = awkward_conversations(spark)
    r = random.Random(8)
    more = [(500 + c, t, r.choice(["user", "assistant", "assistant", "system", "tool"]), r.choice(["a.", "b", "c!", f"{t}?", ""])) for c in range(150) for t in range(r.randint(1, 40))]
    df = df.select(*(x.split()[0] for x in MESSAGES.split(", "))).unionByName(spark.createDataFrame(more, MESSAGES)).withColumns({c: F.lit(1) for c in CLASHING})
    assert repair_rows(conversation_repair.repair(conversation_repair.damaged(df), df)) == brute_repair(rows + more)


def test_repair_empty(spark):
    df = spark.createDataFrame([], MESSAGES)
    assert conversation_repair.repair(df, df).collect() == []


def test_layers_are_few():
    r = random.Random(9)
    layers = conversation_repair.Layers()
    layers.repair(np.array([r.choice([0, 1, 2, 3]) + r.choice([0, 0, 0, 4, 8]) for _ in range(200_000)], np.int32))
    assert len(layers.layers) < 2_000
