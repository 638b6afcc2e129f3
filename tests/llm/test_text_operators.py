"""Operators on texts against brute force, on small tables with nulls, empty and long texts, repeats and clashing columns."""

import base64
import hashlib
import random
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from opsweave.llm import audio, bpe, html_text, mixing, near_duplicates, suffix_dedup, token_counts, toxicity, warc
from opsweave.llm.components import connected_components

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, spans int, h int, part int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, 7, "x", None, 1, None) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def words():
    r = random.Random(3)
    return [" ".join("".join(r.choice(["tion", "er", "an", "the", "é", "zu"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(120, 300))) for _ in range(14)]


@pytest.fixture(scope="module")
def rows(words):
    r = random.Random(4)
    passage = " ".join(words[0].split()[:110])
    out = [(1, None, "a"), (2, "", None), (3, "   \n", "b"), (4, "One", "a"), (5, "one", "a"), (6, "a" * 1500, "b"), (7, "ab " * 400, None)]
    for i, w in enumerate(words):
        out.append((10 + i, w, "abc"[i % 3]))
    out += [(30, words[1], "a"), (31, words[1].upper().replace("É", "é"), "a"), (32, words[2] + " " + passage, "b"), (33, passage + " " + words[3], None), (34, "x" + words[0][200:900] + "y", "c")]
    for i in range(12):  # a chain of near copies
        w = words[4].split()
        for _ in range(i // 2):
            w[r.randrange(len(w))] = "changed"
        out.append((40 + i, " ".join(w), "b"))
    return out


@pytest.fixture(scope="module")
def encoding():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library(spark, rows, encoding):
    got = {r.doc_id: r for r in bpe.encode_digests(table(spark, rows), PATH).collect()}
    for i, t, _ in rows:
        ids = encoding.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    both = bpe.decode_column(bpe.encode_column(table(spark, rows), PATH), PATH).select("text", "bytes").collect()
    assert all(bytes(r.bytes) == (r.text or "").encode() for r in both)
    assert bpe.encode_digests(table(spark, []), PATH).count() == 0


def test_bpe_splits_as_the_pattern(encoding):
    r = random.Random(1)
    letters = [*"abst'smdrevl  \n\t\r   é中1٢!?’.", "'s", "'re", "'ll", " '", "\U0001f600"]
    for _ in range(3000):
        texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(3)]
        got = [[], [], []]
        for i, ids in bpe.encoded(texts, PATH):
            got[i] += ids.tolist()
        assert got == [encoding.encode_ordinary(t) for t in texts]


def test_bpe_long_texts_in_parts(encoding):
    text = ("word 'tis  \n" * 50 + "y" * 300) * 20
    got = [x for _, ids in bpe.encoded([text], PATH, step=500) for x in ids.tolist()]
    assert got == encoding.encode_ordinary(text)


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64))
    assert sorted(bpe.PerfectHash(keys)(keys).tolist()) == list(range(len(keys)))


def test_length_histogram(spark, rows, encoding):
    n = np.array([len(encoding.encode_ordinary(t or "")) for _, t, _ in rows])
    limits = token_counts.context_limits(token_counts.length_histogram(table(spark, rows), PATH))
    got = limits.collect()
    assert sorted(r.n_tokens for r in got) == sorted(set(n.tolist()))
    for r in got:
        assert (r.n_docs, r.docs_within, r.docs_over) == ((n == r.n_tokens).sum(), (n <= r.n_tokens).sum(), (n > r.n_tokens).sum())
        assert (r.total_tokens, r.tokens_within) == (n.sum(), n[n <= r.n_tokens].sum())
        assert r.truncated_total == np.minimum(n, r.n_tokens).sum()
    asked = spark.createDataFrame([(0,), (1,), (17,), (400,), (10**6,), (None,)], "context_limit long")
    for r in token_counts.truncated_totals(limits, asked).collect():
        assert r.truncated_total == np.minimum(n, r.context_limit).sum()
        assert r.docs_over == (n > r.context_limit).sum()
    assert token_counts.length_quantile(limits, 0.5).first()[0] == np.sort(n)[int(np.ceil(len(n) / 2)) - 1]
    assert token_counts.context_limits(token_counts.length_histogram(table(spark, []), PATH)).count() == 0


def brute_removal(rows, length):
    seen: dict[bytes, int] = {}
    data = {i: (t or "").encode() for i, t, _ in rows}
    for d in data.values():
        for k in range(len(d) - length + 1):
            seen[d[k : k + length]] = seen.get(d[k : k + length], 0) + 1
    out = {}
    for i, d in data.items():
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def brute_passages(rows, length):
    seen: dict[tuple, int] = {}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, _ in rows}
    for w in words.values():
        for k in range(len(w) - length + 1):
            seen[tuple(w[k : k + length])] = seen.get(tuple(w[k : k + length]), 0) + 1
    out = {}
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = True
        out[i] = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
    return out


@pytest.mark.parametrize("together", [4096, 2])
def test_repeated_strings(spark, rows, monkeypatch, together):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    got = suffix_dedup.removal_digests(table(spark, rows)).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in got} == brute_removal(rows, 400)
    assert {r.doc_id: r.n_passages for r in got} == brute_passages(rows, 50)
    if together > 2:
        assert suffix_dedup.removal_digests(table(spark, [])).count() == 0


def test_repeats_of_rows_without_or_with_repeated_ids(spark, words):
    rows = [(1, words[0], "a"), (1, "short", "a"), (None, words[0][50:900] + "x", "a"), (None, None, "a"), (2, words[1] + words[0][:700], None), (3, words[3], None), (3, words[3], None)]
    want = brute_removal([(k, t, s) for k, (_, t, s) in enumerate(rows)], 400)
    got = suffix_dedup.removal_digests(table(spark, rows)).collect()
    assert sorted((r.doc_id or 0, *r[1:5]) for r in got) == sorted((rows[k][0] or 0, *v) for k, v in want.items())


def test_repeats_leave_the_texts_at_whole_characters(spark, rows):
    out = suffix_dedup.remove_repeats(table(spark, rows))
    assert out.columns == table(spark, []).columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[1] is None and text[4] == "One" and text[10 + 5] == dict((i, t) for i, t, _ in rows)[10 + 5]
    assert text[30] == "" and len(text) == len(rows)


def brute_components(rows, size):
    sets = {}
    for i, t, _ in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, rows, monkeypatch, size):
    if size == 2:
        monkeypatch.setattr(near_duplicates, "BLOCK", 3)
    got = near_duplicates.near_duplicates(table(spark, rows), size=size).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute_components(rows, size)
    if size == 2:
        assert near_duplicates.near_duplicates(table(spark, [])).count() == 0


def test_near_duplicates_around_one_text(spark, monkeypatch):
    """Two thousand different texts at similarities from 0.4 to 1 to one, in blocks of 100."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base), None)]
    for i in range(1, 2000):
        w = list(base)
        for _ in range(r.randint(0, 45) if i % 2 else r.randint(9, 17)):
            w[r.randrange(150)] = r.choice([f"v{r.randrange(30)}", f"u{i}x{r.randrange(9)}"])
        rows.append((i, " ".join(w), None))
    monkeypatch.setattr(near_duplicates, "BLOCK", 100)
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(table(spark, rows), size=2).collect()}
    sets = [set(zip(t.split(), t.split()[1:], strict=False)) for _, t, _ in rows]
    names = {s: k for k, s in enumerate(set().union(*sets))}
    held = np.zeros((len(rows), len(names)), np.float32)
    for i, s in enumerate(sets):
        held[i, [names[x] for x in s]] = 1
    both = (held @ held.T).astype(int)
    n = np.array([len(s) for s in sets])
    linked = 100 * both >= 80 * (n[:, None] + n - both)
    label = np.arange(len(rows))
    while (low := np.where(linked, label, len(rows)).min(axis=1)).tolist() != label.tolist():
        label = low
    assert 100 < len(set(label.tolist())) < 1900
    assert [got[i] for i in range(len(rows))] == label.tolist()


def test_near_duplicates_ids_and_words(spark):
    """Rows without an id stay, rows of one id are one document, and words of equal polynomial hashes differ."""
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(None, text, None), (None, None, None), (3, text, None), (5, text + " more", None), (5, other, None), (7, other, None), (7, other, None), (8, "", None), (9, thue, None), (10, thue.translate({97: 98, 98: 97}), None)]
    got = near_duplicates.near_duplicates(table(spark, rows), size=2).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id) == [(3, 39, 3, True), (5, 39, 3, False), (5, 40, 3, False), (7, 39, 3, False), (7, 39, 3, False), (8, 0, 8, True), (9, 1, 9, True), (10, 1, 10, True)]
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None) == [(0, None, True), (39, None, True)]


def test_bayesian_test_keeps_similar_pairs():
    r = np.random.default_rng(1)
    a = r.integers(0, 256, (4000, 160)).astype(np.uint8)
    b = np.where(r.random(a.shape) < 0.8, a, r.integers(0, 256, a.shape)).astype(np.uint8)
    assert len(near_duplicates.surviving(a, b, 0.8, 1e-7)) >= 3998
    c = np.where(r.random(a.shape) < 0.3, a, r.integers(0, 256, a.shape)).astype(np.uint8)
    assert len(near_duplicates.surviving(a, c, 0.8, 1e-7)) == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(20)] + [(100, 105), (105, 103), (7, 7), (None, 3), (50, 49)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 105: 100, 103: 100, 49: 49, 50: 49}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing_meets_targets(spark, rows):
    got = mixing.mixed(table(spark, rows)).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, count(t)) for i, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    for s in order:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= max(60, 0.03 * target[s])
    assert all(0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
    again = mixing.mixed(table(spark, rows).repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.mixed(table(spark, [])).count() == 0
    copies = mixing.mix_documents(table(spark, rows))
    assert copies.columns == table(spark, []).columns and copies.count() == sum(r.copies for r in got)


def test_columns_of_any_name_come_out_as_they_went_in(spark, rows):
    own = {"__row": "r", "__packed": "p", "__spans": "s", "__COPIES": "c", "__copy": "d", "size": "z", "row": "o", "part": "q"}
    docs = table(spark, rows)
    docs = docs.withColumns({c: mixing.F.concat(mixing.F.lit(v), docs["doc_id"].cast("string")) for c, v in own.items()})
    for out in (mixing.mix_documents(docs), suffix_dedup.remove_repeats(docs), suffix_dedup.remove_repeats(docs, length=50, unit="words")):
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[c] == (None if r.doc_id is None else f"{v}{r.doc_id}") for r in got for c, v in own.items())
    with pytest.raises(ValueError):
        mixing.mixed(docs, keep=("size",))


def test_multipliers_that_are_not_found_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LOOKS", 1)
    monkeypatch.setattr(mixing, "STEPS", 1)
    cells = spark.createDataFrame([(1, s, 5, s / 20) for s in range(1, 60)], "s int, size long, n long, u double")
    targets = spark.createDataFrame([(1, 100, sum(5 * s for s in range(1, 60)), 5000.0)], "s int, docs long, source_size long, target double")
    with pytest.raises(RuntimeError):
        mixing.multipliers(cells, targets, 3)


def test_mixing_rates_are_tilted_exponentially(spark):
    cells = spark.createDataFrame([(1, s, 5, s / 20) for s in range(1, 60)], "s int, size long, n long, u double")
    targets = spark.createDataFrame([(1, 100, sum(5 * s for s in range(1, 60)), 5000.0)], "s int, docs long, source_size long, target double")
    lam = mixing.multipliers(cells, targets, 3).first().lam
    assert abs(sum(5 * s * min(3, np.exp(lam * s / 20)) for s in range(1, 60)) - 5000) < 0.01


def test_audio_round_trip(spark, rows):
    got = {r.doc_id: r for r in audio.audio_digests(table(spark, rows)).collect()}
    for i, t, _ in rows:
        raw = (t or "").encode()
        data = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (got[i].n_bytes, got[i].payload_bytes) == (len(raw), len(data))
        assert got[i].payload_sha256 == hashlib.sha256(data).hexdigest() and got[i].tail_crc32 == zlib.crc32(data[-64:])
    assert got[1].feature == got[2].feature and got[1].media_sha256 == got[2].media_sha256
    assert audio.audio_digests(table(spark, [])).count() == 0


def test_audio_by_samples_one_after_another(spark, rows):
    """Files, samples, features and stored PCM against plain loops."""
    tables = {audio.MULAW: audio.law_table(audio.MULAW).tolist(), audio.ALAW: audio.law_table(audio.ALAW).tolist()}
    got = {r.doc_id: r for r in audio.audio_digests(table(spark, rows[:24])).collect()}
    for i, t, _ in rows[:24]:
        raw = (t or "").encode()
        data = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        tag = (audio.MULAW, audio.ALAW, audio.IMA_ADPCM)[zlib.crc32(data) % 3]
        media = audio.wave(tag, data)
        assert (got[i].media_bytes, got[i].media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        if tag in tables:
            pcm = [tables[tag][b] for b in data]
        else:
            align, pcm = struct.unpack_from("<H", media, 32)[0], []
            for at in range(0, len(data), align):
                value, index = struct.unpack_from("<hB", data, at)
                index = min(index, 88)
                pcm.append(value)
                for k in range(2 * (align - 4)):
                    nibble = data[at + 4 + k // 2] >> (4 * (k % 2)) & 15
                    step = int(audio.STEPS[index])
                    change = step // 8 + (step if nibble & 4 else 0) + (step // 2 if nibble & 2 else 0) + (step // 4 if nibble & 1 else 0)
                    value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
                    index = max(0, min(88, index + int(audio.CHANGES[nibble])))
                    pcm.append(value)
        out = []
        for k in range(2 * len(pcm)):
            a, b = pcm[k // 2], pcm[min(k // 2 + 1, len(pcm) - 1)]
            out.append(a if k % 2 == 0 else (a + b + 1) // 2)
        stored = audio.wave(audio.PCM, struct.pack(f"<{len(out)}h", *out), 16000)
        assert (got[i].pcm_bytes, got[i].pcm_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        changes = sum((x < 0) != (y < 0) for x, y in zip(pcm, pcm[1:], strict=False))
        assert got[i].feature.split(";")[1:] == [str(len(pcm)), str(max(map(abs, pcm))), str(sum(x * x for x in pcm)), str(changes), f"{zlib.crc32(struct.pack(f'<{len(out)}h', *out)):08x}"]


def test_laws_and_adpcm():
    mu, a = audio.law_table(audio.MULAW), audio.law_table(audio.ALAW)
    assert (mu[0xFF], mu[0x7F], mu[0x00], mu[0x80]) == (0, 0, -32124, 32124)
    assert (a[0xD5], a[0x55], a[0x2A], a[0xAA]) == (8, -8, -32256, 32256)
    blocks = np.random.default_rng(2).integers(0, 256, (7, 64)).astype(np.uint8)
    for block, pcm in zip(blocks, audio.decode_blocks(blocks), strict=True):
        value, index = struct.unpack_from("<hB", block.tobytes())
        index, want = min(index, 88), [value]
        for k in range(120):
            nibble = int(block[4 + k // 2]) >> (4 * (k % 2)) & 15
            step = int(audio.STEPS[index])
            change = step // 8 + (step if nibble & 4 else 0) + (step // 2 if nibble & 2 else 0) + (step // 4 if nibble & 1 else 0)
            value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
            index = max(0, min(88, index + int(audio.CHANGES[nibble])))
            want.append(value)
        assert pcm.tolist() == want
    assert audio.resample(np.array([0, 100, -100], np.int16), 8000, 16000).tolist() == [0, 50, 100, 0, -100, -100]


def test_stored_pcm(spark):
    files = [(1, audio.wave(audio.MULAW, bytes(range(64)))), (2, None), (3, b"RIFF"), (4, audio.wave(audio.IMA_ADPCM, bytes(128)))]
    got = {r.k: r.pcm for r in audio.store_pcm(spark.createDataFrame(files, "k long, media binary")).collect()}
    assert got[2] is None and got[3] is None
    tag, rate, _, data = audio.parse_wave(bytes(got[1]))
    assert (tag, rate, len(data)) == (audio.PCM, 16000, 64 * 2 * 2)
    assert len(audio.parse_wave(bytes(got[4]))[3]) == 242 * 2 * 2


def test_toxicity_learns_from_positives_and_unlabelled(spark, words):
    r = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        w = r.choice(words).split()
        r.shuffle(w)
        toxic = i % 6 == 0
        if toxic:
            w[3:3] = r.sample(["awfulx", "nastyx", "vilex"], 2)
        docs.append((i, " ".join(w[: r.randint(20, 90)]), None))
        labels.append((i, 1, int(toxic)))
    docs += [(1000, None, None), (1001, "", None), (None, "lonely", None)]
    labels += [(None, 1, 1), (5000, 1, 1), (7, 1, None)]
    got = toxicity.toxicity_scores(table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    by = {x.doc_id: x for x in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(600))
    held = [(by[i].predicted, labels[i][2]) for i in range(600) if by[i].held_out]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert by[1000].score == by[1001].score and by[1000].predicted == 0
    none = toxicity.toxicity_scores(table(spark, docs[:5]), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {x.score for x in none} == {0.0}
    kept = toxicity.without_toxic(table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == table(spark, []).columns and kept.count() == sum(x.predicted == 0 for x in got)


def test_toxicity_by_dense_tables(spark, words):
    """Scores against the same learning with dense tables and words as they stand."""
    r = random.Random(9)
    docs, labels = [], []
    for i in range(260):
        w = r.choice(words).split()
        r.shuffle(w)
        if i % 5 == 0:
            w[2:2] = r.sample(["Awfulx,", "nastyx", "vilex!", "grimx"], 3)
        docs.append((i, " ".join(w[: r.randint(10, 60)]), None))
        labels.append((i, 0, int(i % 5 == 0)))
    got = {x.doc_id: x.score for x in toxicity.toxicity_scores(table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    sets = {i: set(re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", lower(t))) for i, t, _ in docs}
    learn = [i for i, _, _ in docs if zlib.crc32(str(i).encode()) % 4 != 2]
    positive = [i for i in learn if labels[i][2]]
    prior = len(positive) / len(learn)
    kept = []
    unique = lambda ids: list({frozenset(sets[i]) for i in ids})
    p_sets, u_sets = unique(positive), unique(learn)
    for word in sorted(set().union(*sets.values())):
        p, u = (sum(word in s for s in x) + 0.5 for x in (p_sets, u_sets))
        both = (p + u) / (len(positive) + len(learn) + 2)
        part = lambda k, n: k * np.log(k / (n * both)) + (n - k) * np.log((n - k) / (n * (1 - both)))
        if 2 * (part(p, len(positive) + 1) + part(u, len(learn) + 1)) >= 12:
            kept.append(word)
    xp, xu = (np.array([[w in sets[i] for w in kept] for i in ids], float) for ids in (positive, learn))
    w, b = np.zeros(len(kept)), np.log(prior / (1 - prior))
    m1, m2 = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for t in range(1, 801):
        p, u = 1 / (1 + np.exp(-(xp @ w + b))), 1 / (1 + np.exp(-(xu @ w + b)))
        risk = -np.log(1 - u).mean() + prior * np.log(1 - p).mean()
        dp, du = (-prior * (1 - p) / len(p) - prior * p / len(p), u / len(u)) if risk >= 0 else (prior * p / len(p), -u / len(u))
        grad = np.append(xp.T @ dp + xu.T @ du + 1e-5 * w, dp.sum() + du.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        step = 0.1 / (1 + t / 100) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-4)
        w, b = w - step[:-1], b - step[-1]
    assert kept
    for i, _, _ in docs:
        want = 1 / (1 + np.exp(-(b + sum(x for x, word in zip(w, kept, strict=True) if word in sets[i]))))
        assert abs(got[i] - want) < 1e-4


def test_html_layout():
    page = """<head><title>x</title><style>p{}</style></head><body><p>One<p>Two <b>bold</b> text<!-- no --><ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>
    <table><tr><th>n<th>value<th>z<tr><td>wide one<td>b<td>q</table>tail<div hidden>no <p>no</div><span style="display: none">no</span>
    <pre>x\n  y</pre>z &amp; w</p></wrong><dl><dt>t<dd>d1<dd>d2</dl>end<script>if (a < b) "</p>"</script>"""
    want = ["One", "", "Two bold text", "", "- a", "- b", "  3. c", "  4. d", "", "n         value  z", "wide one  b      q", "", "tail", "", "x", "  y", "", "z & w", "", "t", "    d1", "    d2", "", "end"]
    assert html_text.render(page).split("\n") == want
    for broken in (None, "", "<", "<p", "<table><td>", "</td></tr>", "<ul><li>" * 3000, "&#xD800; &bogus;", "<!--", "<td>a</td>", "<script>"):
        assert isinstance(html_text.render(broken), str)


def test_html_pages(spark):
    rows = [(1, "u", "<p>a<p>b"), (2, None, None), (2, "x", ""), (None, None, "<p>é")]
    got = html_text.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_lines) for r in got) == [(0, "é", 1), (1, "a\n\nb", 3), (2, "", 0), (2, "", 0)]


def test_warc_derivatives(spark, tmp_path):
    rows = [(1, "http://a/", "<title>T</title><p>Hi &amp; <a href=x>you</a>"), (2, None, None), (3, "http://b/", "é" * 50)]
    responses = warc.responses_from_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    made = warc.serialised(warc.derivatives(responses, keep=("page_id",))).collect()
    ids = {r.page_id: r.record_id for r in responses.collect()}
    assert len(made) == 6 and all(r.refers_to == ids[r.page_id] for r in made)
    for r in made:
        assert r.content_length == len(r.block.encode()) and r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
    text = {r.page_id: r.block for r in made if r.warc_type == "conversion"}
    assert text == {1: "Hi & you", 2: "", 3: "é" * 50}
    (tmp_path / "x.warc").write_bytes(b"".join(bytes(r.record) for r in made))
    back = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r.warc_type, r.record_id, r.refers_to, r.payload) for r in back) == sorted((r.warc_type, r.record_id, r.refers_to, r.block) for r in made)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds", "So x=2 holds"),
        ("<math><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>tex</annotation></math>", "1 2"),
        ("<p>Pick <select><optgroup label='Fruit &amp; nuts'><option>Pear<option selected>Fig</select> now", "Pick\nFruit & nuts\nPear\nFig\nnow"),
        ("<p>Say<textarea>\na <b>&lt; c\n  d</textarea>end", "Say\na <b>< c\n  d\nend"),
        ("a<svg><title>t</title><defs><text>no</text></defs>stray<path d=''/><text x=1>Label <tspan>one</tspan></text><text>Two</text></svg>b", "a\nLabel one\nTwo\nb"),
        ("<svg/>a<svg><text>In</text><p>After", "a\nIn\n\nAfter"),
        ("<svg><foreignObject><p>Shown</p></foreignObject></svg>", "Shown"),
    ],
)
def test_formulas_forms_and_drawings_are_shown(page, text):
    assert html_text.render(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("a<noscript>b</noscript> <object data=x>c</object>", "ab c"),
        ("<table><tr><td>one<td>two<td>three<tr><td colspan=2>wide cell here<td>x<tr><td>1<td>2<td>3</table>", "one  two  three\nwide cell here  x\n1    2    3"),
        ("<table><tr><td rowspan=2>tall<td>a<tr><td>b<tr><td>c<td>d</table>", "tall  a\n      b\nc     d"),
        ("<a title='x>y'>z</a>", "z"),
        ('<p>seen<a title="x>lost</a>', "seen"),
        ("a < b and <3 </ 4>", "a < b and <3"),
        ("x<b", "x"),
        ("<ul><li>a<ul><li>b<p>c</ul><li>d</ul>", "- a\n  - b\n\n    c\n- d"),
        ("<blockquote>q<blockquote>r</blockquote></blockquote>", "> q\n>\n> > r"),
    ],
)
def test_markup_as_browsers_read_it(page, text):
    assert html_text.render(page) == text


@pytest.mark.parametrize("piece", ['<a "', "<ul><li>x", "<a <", "<!", "<table><tr><td>x", "<p><table><td><div>", "<blockquote>q", "<a x='", "<", "<p><span>", "<tr><td colspan=99 rowspan=99>x"])
def test_bad_markup_takes_linear_time(piece):
    took = []
    for size in (1 << 15, 1 << 18):
        began = time.process_time()
        html_text.render(piece * (size // len(piece)))
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.02)


def test_every_word_of_random_markup_is_shown_in_order():
    r = random.Random(11)
    tags = "p div ul ol li blockquote span b table tr td th h1 pre dl dt dd section a select option".split()
    for _ in range(300):
        parts = []
        for k in range(r.randint(1, 60)):
            parts.append(r.choice([f"w{k} ", f"<{r.choice(tags)}>", f"</{r.choice(tags)}>", f"<{r.choice(tags)} class='x' title=\"a>b\">" if r.random() < 0.2 else f"w{k}a"]))
        page = "".join(parts)
        want = re.findall(r"w[0-9]+a?", re.sub(r"<[a-z0-9]+ class='x' title=\"a>b\">", " ", re.sub(r"</?[a-z0-9]+>", " ", page)))
        assert sorted(re.findall(r"w[0-9]+a?", html_text.render(page))) == sorted(re.findall(r"w[0-9]+a?", " ".join(want)))
