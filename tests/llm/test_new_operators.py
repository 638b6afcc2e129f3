"""Exact dedup by an index, conversation repair, ranked search: against brute force, odd rows, empty tables."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest

from opsweave.llm import conversations, cuckoo_index, lexical_search
from opsweave.llm.common import scratch, shared_dir

DOCS = "doc_id long, text string, digest string, row long, part string"


def texts(seed, n):
    r = random.Random(seed)
    words = ["a", "b", "été", "x\x00y", "", "  ", "\t", "\n"]
    out = [(i, r.choice([None, *(r.choice([" ", "  ", "\n"]).join(r.choices(words, k=r.randint(0, 4))) for _ in range(3))]), "d", 7, "p") for i in range(n)]
    return out + [(3, out[3][1], "again", 1, None), (None, "only here", None, None, None), (None, "only here", None, None, None), (None, out[5][1], None, None, None)]


def equal_texts(rows):
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    return {t: (min((i for i in ids if i is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items()}


def test_exact_dedup(spark):
    rows = texts(1, 300)
    got = cuckoo_index.exact_dedup(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    want = equal_texts(rows)
    of = {}
    for i, text, *_ in rows:
        of.setdefault(i, set()).add(want[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")])
    assert len(got) == len(rows)
    for x in got:
        assert (x.keep_id, x.group_size, x.text_sha256) in of[x.doc_id]
        assert not x.kept or x.doc_id == x.keep_id
    # Of each group one row stays, also of rows that repeat an id and of those without any.
    assert Counter(x.text_sha256 for x in got if x.kept) == {v[2]: 1 for v in want.values()}
    assert cuckoo_index.exact_dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_a_filter_overflows_and_is_built_again():
    live = cuckoo_index.LiveDigests()
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for d in digests:
        assert live.get(d) is None
        live.add(d, 1, (False, 1, 1))
    assert live.filter.buckets > cuckoo_index.SMALLEST and len(live) == 3000 and all(live.get(d) for d in digests)
    for d in digests[::2]:
        assert live.discard(d) and not live.discard(d)
    assert [live.get(d) is not None for d in digests] == [i % 2 == 1 for i in range(3000)]
    assert sum(d in live.filter for d in digests[::2]) < 50
    part = cuckoo_index.LiveDigests(cuckoo_index.CuckooFilter(4), complete=False)
    for d in digests[:40]:
        part.add(d, 1, (False, 1, 1))
    assert part.full and len(part) == 40


def test_an_index_takes_batches_in_and_out(spark):
    r = random.Random(4)
    index = cuckoo_index.CuckooIndex(spark, shards=3)
    live = []
    for step in range(4):
        batch = [(100 * step + i, r.choice(["a", "b", None, f"t{r.randint(0, 30)}", f"u{step} {i}"])) for i in range(60)]
        table = spark.createDataFrame(batch, "doc_id long, text string")
        live += [(i, t or "") for i, t in batch]
        got = {x.doc_id: (x.keep_id, x.group_size, x.kept) for x in index.insert(table).collect()}
        groups = {}
        for i, t in live:
            groups.setdefault(t, []).append(i)
        assert got == {i: (min(groups[t or ""]), len(groups[t or ""]), i == min(groups[t or ""])) for i, t in batch}
        gone = r.sample(live, 25)
        index.delete(spark.createDataFrame([*gone, (-5, "a"), (None, "b")], "doc_id long, text string"))
        live = [x for x in live if x not in gone]
        groups = {}
        for i, t in live:
            groups.setdefault(t, []).append(i)
        asked = spark.createDataFrame([(1, "a"), (2, None), (3, "never"), *[(10 + n, f"t{n}") for n in range(31)]], "doc_id long, text string")
        for x in index.lookup(asked).collect():
            t = {1: "a", 2: "", 3: "never"}.get(x.doc_id, f"t{x.doc_id - 10}")
            assert (x.live, x.keep_id, x.group_size) == ((True, min(groups[t]), len(groups[t])) if t in groups else (False, None, 0))


def test_tables_go_with_their_scope(spark, tmp_path):
    import os

    before = set(os.listdir(shared_dir(spark)))
    with scratch(spark):
        cuckoo_index.exact_dedup(spark.createDataFrame(texts(2, 20), DOCS)).write.parquet(str(tmp_path / "out"))
    assert set(os.listdir(shared_dir(spark))) == before


# Conversations


def brute_repair(rows):
    """Cheapest audit by trying: rows are (turn, role, text) in order. Dijkstra over whole strings, without states of blocks."""
    seen, faults = set(), []
    for _, role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("cut" if text.rstrip(" \t\n\v\f\r")[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, said = heapq.heappop(heap)
        key = (at, roles[-1:] if roles else "-")
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            text = "\n".join(said)
            return cost, audit, text, faults
        if key in done and at < len(rows):
            continue
        done.add(key)
        def fits(more):
            return re.fullmatch(r"s?(ua)*u?", roles + more) is not None
        for role in ("user", "assistant"):
            if fits(role[0]) and audit[-6:] != "IIIIII":
                heapq.heappush(heap, (cost + 3, audit + "I", at, roles + role[0], (*said, f"{role}:")))
        if at == len(rows):
            continue
        _, role, text = rows[at]
        heapq.heappush(heap, (cost + 4, audit + "D", at + 1, roles, said))
        if faults[at] in ("", "cut"):
            more = 3 if faults[at] else 0
            if role[:1] and role[0] in "sua" and fits(role[0]):
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles + role[0], (*said, f"{role}:{text}")))
            for to in ("user", "assistant"):
                if fits(to[0]):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, roles + to[0], (*said, f"{to}:{text}")))


def report(rows):
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    cost, audit, text, faults = brute_repair(rows)
    turns = sorted({t for t, _, _ in rows if t is not None})
    gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("cut"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        row = (turn, "user" if k == 4 else role, text)
        out[conv] += [] if k == 0 else [row, row] if k == 3 else [row]
    return out


def conversation(r, conv, n):
    said = ["Hi.", "So?", "Cut off", "  ", "Yes!\n", "Hi.", "été"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", ""]
    return [(conv, t, r.choice(roles), r.choice(said) + r.choice(["", f" {t}."])) for t in r.sample(range(3 * n), n)]


SCHEMA = "conv_id long, turn long, role string, text string"


def shown(table):
    return {x.conv_id: tuple(x)[1:] for x in table.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


@pytest.mark.parametrize("block", [conversations.BLOCK, 3])
def test_conversations_are_repaired(spark, block, monkeypatch):
    """Also where a conversation reaches over several blocks, and blocks over several rounds."""
    monkeypatch.setattr(conversations, "BLOCK", block)
    monkeypatch.setattr(conversations, "FAN", 2)
    r = random.Random(7)
    rows = [x for c in range(40) for x in conversation(r, c, r.randint(1, 7))] + conversation(r, 99, 14)
    rows += [(None, None, "user", "Hello."), (None, 4, None, None), (200, None, None, "x"), (200, 1, "user", None)]
    dropped = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows.append((dropped, 1, "user", "gone."))
    got = shown(conversations.damage_report(spark.createDataFrame([(*x, "z") for x in rows], SCHEMA + ", conv string").repartition(3)))
    assert got == {c: report(d) for c, d in damage(rows).items()}
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_conversations(spark):
    """Thousands of turns in one conversation: repaired in blocks, the same as in one piece."""
    r = random.Random(8)
    rows = [(1, t, r.choice(["user", "assistant"]), f"{t}." if r.random() < 0.8 else r.choice(["", "same.", "cut"])) for t in range(2500)]
    rows += [(2, 1, "user", "x" * 1_500_000 + "."), (2, 2, "assistant", "y.")]
    got = shown(conversations.damage_report(spark.createDataFrame(rows, SCHEMA)))
    assert got == {c: report(d) for c, d in damage(rows).items()}
    assert shown(conversations.damage_report(spark.createDataFrame([], SCHEMA))) == {}


def test_repaired_messages_are_conversations(spark):
    r = random.Random(9)
    rows = [(*x, False, 0) for c in range(20) for x in conversation(r, c, 5)]
    alone, several = conversations.repaired(spark.createDataFrame(rows, SCHEMA + ", dropped boolean, copy int"))
    for x in [*alone.collect(), *several.collect()]:
        assert re.fullmatch("(s?(ua)+)?", "".join(m.role[:1] for m in x.messages))


# Ranked search


def ranked(docs, items, top):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    split = lambda t: term.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    counted = [(i, Counter(split(t))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n_docs, total = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    out = []
    for item, own in asked.items():
        scores = []
        for i, c, n in counted:
            m = 100 - 50 + (50 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def search(spark, docs, items, top):
    d = spark.createDataFrame([(*x, 1, "x") for x in docs], "doc_id long, text string, n long, item_id string").repartition(3)
    b = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, doc_id long")
    return sorted(map(tuple, lexical_search.ranked_search(d, b, top).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("cells,leaf,terms", [(1 << 23, 64, 1 << 13), (1 << 10, 3, 40)])
def test_ranked_search(spark, cells, leaf, terms, monkeypatch):
    """Also with small trees and leaves, and items in several blocks."""
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    monkeypatch.setattr(lexical_search, "LEAF", leaf)
    monkeypatch.setattr(lexical_search, "TERMS", terms)
    r = random.Random(3)
    words = [f"W{int(r.paretovariate(0.6)) % 90}é" for _ in range(400)] + ["The", "the", "a_b", "\x00", "--", "0"]
    docs = [(i, " ".join(r.choices(words, k=r.randint(0, 40)))) for i in range(400)]
    docs += [(1000 + i, docs[5][1]) for i in range(90)] + [(5, docs[5][1]), (None, docs[7][1]), (None, None), (2000, None), (2001, "-- ++"), (2002, "The " * 3000)]
    items = [(i, " ".join(r.choices(words, k=12))) for i in range(30)] + [(100, None), (101, "--"), (102, "unheard"), (None, "The"), (3, "W1é 0")]
    assert search(spark, docs, items, 7) == ranked(docs, items, 7)


def test_ranked_search_of_long_texts_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "PIECE", 1000)
    docs = [(1, "alpha beta " * 120_000), (2, "beta" * 300_000 + " alpha"), (3, "gamma"), (4, "alpha")]
    items = [(1, "alpha gamma"), (2, "beta")]
    assert search(spark, docs, items, 50) == ranked(docs, items, 50)
    assert search(spark, [], items, 50) == [] == search(spark, docs, [], 50)
    assert search(spark, [(1, None)], items, 50) == []
