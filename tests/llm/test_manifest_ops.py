"""Conversation repair, fingerprints and the Merkle manifest against plain Python on odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from check import rows_of
from failscope.llm import conversations, fingerprints, merkle
from failscope.llm.oracle import OP11, OP13
from test_corpus_ops import docs, fold, none, texts  # noqa: F401

duckdb = pytest.importorskip("duckdb")
WHITE = " \t\n\x0b\x0c\r"


# --- conversations ----------------------------------------------------------------------------

def least_word(rows):
    """Cheapest, then ASCII-least edits by Dijkstra over (cost, word): rows are (initial, fault)."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, word, i, last = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, word
        if (i, last) in done:
            continue
        done.add((i, last))
        heapq.heappush(heap, (cost + 2, word + "I", i, after[last]))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 3, word + "D", i + 1, last))
            if fault not in ("blank", "duplicate"):
                cost += fault == "truncated"
                heapq.heappush(heap, (cost + 2, word + "R", i + 1, after[last]))
                if initial == after[last] or (initial, last) == ("s", ""):
                    heapq.heappush(heap, (cost, word + "K", i + 1, initial))


def brute_repair(table):
    groups = defaultdict(list)
    for conv, turn, role, text in table:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        rows = groups[conv]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.rstrip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        cost, word = least_word([(r[1][:1], f) for r, f in zip(rows, faults, strict=True)])
        lines, left, last = [], iter(rows), ""
        for c in word:
            if c == "D":
                next(left)
                continue
            role = "assistant" if last == "u" else "user"
            text = ""
            if c != "I":
                _, old, text = next(left)
                role = old if c == "K" else role
            lines.append(f"{role}:{text}")
            last = role[0]
        turns = [r[0] for r in rows if r[0] is not None]
        n = Counter(faults)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, word, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talk():
    """Conversations of 1 to 90 rows with odd roles, turns and texts; one id and one turn hold many rows."""
    rng = random.Random(11)
    rows = []
    for conv in [*range(60), None, -5]:
        for turn in range(rng.choice([1, 2, 3, 5, 8, 30])):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "User", None, "unknown"])
            text = rng.choice(["Hi.", "Why?", "cut off", "", " \t", None, "Same!", "É so.\n", f"Turn {turn}.", "a" * 3000 + "."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, text))
    rows += [(7, t, "user" if t % 2 else "assistant", f"{t % 40}.") for t in range(90)]
    rows += [(8, 3, "user", "Again.")] * 25 + [(9, 3, "user", f"{i}") for i in range(40)]
    return rows


CONV = "conv_id long, turn long, role string, text string, SEQ int, gaps string"


@pytest.mark.parametrize("block_rows,block_bytes", [(256, 4_000_000), (3, 4_000_000), (40, 50), (1, 10)])
def test_conversations(spark, talk, block_rows, block_bytes):
    table = spark.createDataFrame([(*r, 1, "x") for r in talk], CONV).repartition(3)
    got = conversations.repair(table, block_rows, block_bytes).collect()
    want = brute_repair(talk)
    assert len(got) == len(want)
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want


def test_conversations_like_sql(spark, talk):
    import pandas as pd

    frame = pd.DataFrame(talk, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", frame)
    cur = con.execute(OP11)
    got = conversations.repair(spark.createDataFrame([(*r, 1, "x") for r in talk], CONV))
    assert rows_of(got.columns, got.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_all_rows_dropped_and_empty(spark):
    gone = next((c, t) for c in range(99) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    table = spark.createDataFrame([(*gone, "user", "Hi.", 1, "x")], CONV)
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in conversations.repair(table).collect()] == [(gone[0], 0, 0, 0, 0, 0, 0, "", empty)]
    assert conversations.repair(table.limit(0)).collect() == []


def test_least_words_of_all_short_conversations():
    """Every sequence of up to four kinds of rows, and random long ones in blocks of all sizes."""
    import itertools

    kinds = "suaxSUAXd"
    faults = lambda k: (k.lower(), "blank" if k == "d" else "truncated" if k.isupper() else "")
    for n in range(5):
        for word in itertools.product(kinds, repeat=n):
            assert conversations.whole("".join(word)) == least_word([faults(k) for k in word])
    rng = random.Random(3)
    for size in (1, 2, 7, 30):
        word = "".join(rng.choice(kinds) for _ in range(60))
        parts = [word[i : i + size] for i in range(0, 60, size)]
        weights = [conversations.entries(p) for p in parts] + [[None] * 16]
        for q in range(4):
            weights[-1][4 * q] = min(conversations.cheapest("", q, True).values())
        costs = [[-1 if e is None else e[0] for e in w] for w in weights]
        total, _, ways = conversations.chain(costs, [conversations.ranks([e and e[1] for e in w]) for w in weights])
        found = "".join(w[4 * int(a) + int(b)][1] for w, a, b in zip(weights, ways[0], ways[0][1:], strict=False))
        assert (total[0], found) == least_word([faults(k) for k in word])


# --- fingerprints -----------------------------------------------------------------------------

def signed(x):
    return x - 2**64 if x >= 2**63 else x


def spark_hash(*values):
    """Spark's xxhash64 of ints and strings, as an unsigned number."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v.to_bytes(4, "little")
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", fold(text)) if w]
    if not words:
        return ""
    if len(words) < 5:
        hashes = [spark_hash(0, " ".join(words))]
    else:
        hashes = [spark_hash(5, *words[i : i + 5]) for i in range(len(words) - 4)]
    best = {}
    for h in hashes:
        best[h >> 57] = min(h, best.get(h >> 57, h))
    # Places follow the signed order of the values.
    filled = sorted(best, key=lambda b: signed(best[b]))
    out = []
    for j in range(128):
        source = j
        if j not in best:
            _, at = min((signed((spark_hash(j, b) & ~127) | i), i) for i, b in enumerate(filled))
            source = filled[at]
        out.append(f"{best[source] & 255:02x}")
    return "".join(out)


def brute_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    same = sum(a[i : i + 2] == b[i : i + 2] for i in range(0, 256, 2)) / 128
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def test_fingerprints(spark, docs, none, texts):  # noqa: F811
    rows = sorted(fingerprints.fingerprints(docs).collect())
    assert [r["doc_id"] for r in rows] == list(range(len(texts)))
    for i, r in enumerate(rows):
        text, following = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == brute_fingerprint(text)
        assert r["edited_fingerprint"] == brute_fingerprint(edited)
        assert r["near_edited"] == pytest.approx(brute_likeness(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(brute_likeness(r["fingerprint"], brute_fingerprint(following)))
    assert fingerprints.fingerprints(none).collect() == []


def test_fingerprints_of_repeated_and_nameless_rows(spark):
    table = [(None, "first of all"), (3, "b"), (3, "b"), (3, "a much longer text than the others"), (9, None), (1, "one two three four five six")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in table], "doc_id long, text string, FINGERPRINT int").repartition(4)
    rows = fingerprints.fingerprints(frame).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in table)
    assert {r["fingerprint"] for r in rows} == {brute_fingerprint(t or "") for _, t in table}
    first = next(r for r in rows if r["doc_id"] is None)
    edited = "first " + "one tw"
    assert first["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    one = fingerprints.fingerprints(frame.filter("doc_id = 1")).collect()
    assert [(r["doc_id"], r["near_next"]) for r in one] == [(1, 1.0)]


def test_likeness_estimates_similarity(spark):
    """Mean error over pairs of known similarity stays within a few standard errors, also for few shingles."""
    rng = random.Random(5)
    rows, truth = [], {}
    for size in (12, 60, 400):
        for k in range(60):
            a = [f"w{rng.randrange(10**9)}" for _ in range(size)]
            b = list(a)
            cut = rng.randrange(size)
            b[cut:] = [f"w{rng.randrange(10**9)}" for _ in range(size - cut)]
            sets = [{tuple(x[i : i + 5]) for i in range(size - 4)} for x in (a, b)]
            truth[len(rows)] = (size, len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
            rows.append((len(rows), " ".join(a), " ".join(b)))
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, "i long, a string, b string")
    prints = frame.select("i", fingerprints.fingerprint(F.col("a")).alias("a"), fingerprints.fingerprint(F.col("b")).alias("b"))
    got = prints.select("i", fingerprints.likeness(F.col("a"), F.col("b")).alias("j")).collect()
    for size in (12, 60, 400):
        errors = [r["j"] - truth[r["i"]][1] for r in got if truth[r["i"]][0] == size]
        assert abs(sum(errors) / len(errors)) < 0.04
        assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < (0.2 if size == 12 else 0.08)


def test_fingerprints_stay_in_the_jvm(spark, docs):  # noqa: F811
    plan = fingerprints.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|MapPartitions", plan)


# --- Merkle manifest --------------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """(root, sibling lists as (left, right) for each leaf)."""
    ways, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for leaf, i in enumerate(at):
            ways[leaf].append((level[i - 1], "") if i % 2 else ("", level[i + 1] if i + 1 < len(level) else ""))
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], ways


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: sha("".join(map(field, (r[0], r[3], r[2], n, r[1]))))
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    names = sorted(langs, key=lambda v: (v is not None, (v or "").encode()))
    trees = {v: tree([x[2] for x in sorted(langs[v], key=lambda x: x[:3])]) for v in names}
    root, tops = tree([trees[v][0] for v in names])
    out = []
    for v, top in zip(names, tops, strict=True):
        for (_, _, own, r), way in zip(sorted(langs[v], key=lambda x: x[:3]), trees[v][1], strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            h = leaf(r, r[4] + 1) if hit else own
            for left, right in way + top:
                h = sha(left + h + right)
            out.append((r[0], own, trees[v][0], root, sha("".join(a + b for a, b in way + top)), h, h == root))
    return out


@pytest.mark.parametrize("bits", [1, 2, 4, 10])
def test_manifest(spark, bits):
    rng = random.Random(2)
    langs = [None, "", "de", "en", "en", "en", "É", "z"] + [f"l{i}" for i in range(7)]
    rows = [
        (i, rng.choice([None, "", "t", "É" * 40, "x" * 3000]), rng.choice(langs), rng.choice([None, "s", ""]), rng.choice([None, 0, 5, 2**63 - 1]))
        for i in range(80)
    ]
    rows += [rows[3]] * 3 + [(5, "other", "en", "s", 1), (None, "a", "en", None, 1), (None, None, None, None, None), (-4, "t", "only", "s", 3)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, TREE string")
    got = merkle.audit(frame.repartition(3), bits)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute_manifest(rows), key=key)


def test_manifest_of_one_and_no_rows_and_like_sql(spark, docs, none):  # noqa: F811
    assert merkle.audit(none).collect() == []
    one = merkle.audit(docs.filter("doc_id = 4")).collect()
    assert one[0]["leaf"] == one[0]["root"] == one[0]["subroot"] and one[0]["proof_sha256"] == sha("")
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source", "n_chars").toPandas())
    cur = con.execute(OP13)
    got = merkle.audit(docs, 2)
    assert rows_of(got.columns, got.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())
