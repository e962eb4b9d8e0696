"""The pipeline operators against brute force, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from maskwright.llm import jaccard_join as jj
from maskwright.llm import links
from maskwright.llm import near_duplicates as nd
from maskwright.llm.contamination import contamination, keep_clean
from maskwright.llm.gated_model import Settings, score_documents
from maskwright.llm.jaccard_join import jaccard_join
from maskwright.llm.line_dedup import drop_lines, keep_bitmaps
from maskwright.llm.near_duplicates import keep_one, near_duplicates
from maskwright.llm.pieces import encode_samples
from maskwright.llm.quality import keep_good, quality
from maskwright.llm.queries import tokenizer_file
from maskwright.llm.repeats import remove_repeats
from maskwright.llm.texts import U64
from maskwright.llm.token_files import encode_to_files, read_back
from maskwright.llm.warc import read_archives, write_archives

SCHEMA = "doc_id long, text string, source string, n_words long, line string, label string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, low=True):
    text = text or ""
    return WORD.findall(text.translate(LOW) if low else text)


def corpus():
    """Nulls, empties, repeats, ties, a very long text, non-ASCII, and columns with the operators' own names."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeéß日", k=rng.randint(2, 7))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n))

    shared = [f"This Line is shared by many documents, number {i}, and long enough" for i in range(6)]
    base = prose(160).split()
    texts = [None, "", " \n\t\n", "one", "two words", "\n\n"]
    for i in range(30):
        lines = [prose(rng.randint(3, 30)) for _ in range(rng.randint(1, 6))]
        if i % 2:
            lines.insert(1, "  " + shared[i % 6].upper() + "\t")
        if i % 3 == 0:
            lines += [shared[i % 6]] * 2
        texts.append("\n".join(lines))
    for i in range(30):  # near copies of a text that is not there itself
        copy = list(base)
        for at in rng.sample(range(160), rng.randint(1, 6)):
            copy[at] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [texts[8]] * 3 + ["spam spam " * 60, prose(6000), "x" * 5000, "é" * 260]
    # Words whose polynomial hashes modulo 2 ** 64 are equal for every odd base.
    folded = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    texts += [folded, folded.translate(str.maketrans("ab", "ba"))]
    rows = [(i * 3, t, "s", 7, "l", "b") for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, texts[12], None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def order(value):
    return (value is not None, value)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_line_dedup(docs, rows, empty):
    holders = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate(LOW)
            if len(key) >= 40:
                holders.setdefault(key, set()).add(order(r[0]))
    expected = []
    for r in rows:
        kept = [line for line in (r[1] or "").split("\n")
                if len(h := holders.get(line.strip(" \t\n\x0b\x0c\r").translate(LOW), ())) < 5 or order(r[0]) == max(h)]
        expected.append((r[0], "\n".join(kept), *r[2:]))
    got = drop_lines(docs)
    assert got.columns == docs.columns
    clean = [(r[0], r[1] or "", *r[2:]) for r in map(tuple, got.collect())]
    assert sorted(map(repr, clean)) == sorted(map(repr, expected))
    assert any(r.n_dropped for r in keep_bitmaps(docs).collect())
    assert drop_lines(empty).count() == 0


def test_quality(docs, rows, empty):
    got = {}
    for r in quality(docs).collect():
        got.setdefault(r.doc_id, set()).add(tuple(r)[1:6] + (r.base_failed,))
    for r in rows:
        w = words(r[1], low=False)
        threes = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) if threes[tuple(w[i:i + 3])] > 1 for k in range(3)}
        seen, duplicates = set(), 0
        for line in (r[1] or "").split("\n"):
            if WORD.search(line):
                duplicates += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r[1] or "")), duplicates, len(covered),
                len(w) < 50 or 2 * len(covered) > len(w))
        assert got[r[0]] == {want}
    kept = keep_good(docs)
    assert kept.schema == docs.schema
    texts = {r.text for r in kept.collect()}
    assert "spam spam " * 60 not in texts and None not in texts and len(texts) > 20
    assert quality(empty).count() == keep_good(empty).count() == 0


def test_quality_bands_reject_repetition_and_noise(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(900)]
    prose = " ".join(rng.choices(vocabulary, k=900))
    noise = " ".join("".join(chr(rng.randint(33, 126)) for _ in range(40)) for _ in range(120))
    cycle = " ".join(" ".join(rng.choices(vocabulary, k=2)) + f" {i % 7} again and again it goes round" for i in range(60))
    stuck = prose[:3000] + "\n" + "\n".join(f"row {i % 3} {'=' * 60}" for i in range(200))
    frame = spark.createDataFrame([(1, prose), (2, noise), (3, "ab " * 2000), (4, stuck)], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in quality(frame).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False}
    assert cycle


def near_reference(rows, size, percent):
    sets, groups = [], {}
    for r in rows:
        w = words(r[1])
        k = min(size, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for (r, a), (q, b) in itertools.combinations(zip(rows, sets, strict=True), 2):
        if a and b and r[0] is not None and q[0] is not None and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(r[0]), find(q[0])))
            parent[y] = x
    for r, s in zip(rows, sets, strict=True):
        root = None if r[0] is None else find(r[0])
        groups.setdefault(r[0], set()).add((len(s), root, r[0] == root))
    return groups


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 85, 1024), (3, 85, 4), (5, 80, 8)])
def test_near_duplicates(docs, rows, empty, monkeypatch, size, percent, block):
    monkeypatch.setattr(links, "BLOCK", block)
    want = near_reference(rows, size, percent)
    assert len({x for s in want.values() for _, x, _ in s}) < len(want) - 8  # there is something to find
    got = {}
    for r in near_duplicates(docs, size, percent).collect():
        got.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id, r.kept))
    assert got == want
    if block == 1024:
        assert keep_one(docs, size, percent).columns == docs.columns
        assert near_duplicates(empty).count() == keep_one(empty).count() == 0


@pytest.mark.parametrize(("size", "percent", "packed"), [(5, 80, 1_500_000), (3, 70, 200), (2, 50, 1_500_000)])
def test_jaccard_join(docs, rows, empty, monkeypatch, size, percent, packed):
    monkeypatch.setattr(jj, "PACKED", packed)
    monkeypatch.setattr(links, "BLOCK", 4)
    want = {i: {x[:2] for x in s} for i, s in near_reference(rows, size, percent).items()}
    assert len({x for s in want.values() for _, x in s}) < len(want) - 8
    got = {}
    for r in jaccard_join(docs, size, percent).collect():
        got.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert got == want
    if packed == 200:
        assert jaccard_join(empty).count() == 0


def test_similar_sets_share_a_signature():
    """Pairs of every size, with as many differences as the similarity allows, spread at random or bunched."""
    rng = np.random.default_rng(4)
    for percent in (80, 90, 60):
        pairs = []
        for a in [*range(3, 60), 100, 127, 128, 300, 1000, 2600]:
            for b in {a, a + 1, a * 100 // percent}:
                extra = [x for x in range(b + 1) if 100 * (a - x) >= percent * (b + x)]  # of the first alone
                if not extra or (b == a and max(extra) == 0):
                    continue
                x = max(extra)
                features = np.unique(rng.integers(0, 1 << 63, 2 * (a + b) + 9, np.uint64) * U64(2))
                features = rng.permutation(features) if a % 2 else features  # else differences lie next to each other
                one, two = features[:a], np.r_[features[x:a], features[a:a + b - a + x]]
                assert 100 * len(np.intersect1d(one, two)) >= percent * len(np.union1d(one, two))
                pairs += [np.sort(one), np.sort(two)]
        offsets = np.r_[0, np.cumsum([len(p) for p in pairs])]
        which, key = jj.signatures(np.concatenate(pairs), offsets, percent)
        of = [set(key[which == i].tolist()) for i in range(len(pairs))]
        for i in range(0, len(pairs), 2):
            assert of[i] & of[i + 1] or np.array_equal(pairs[i], pairs[i + 1])


def test_signature_limit_and_chunks():
    for percent in (80, 85, 95):
        limit = nd.limit_of(percent)
        chunks = nd.chunks_of(limit)
        assert [i for c in chunks for i in c] == list(range(nd.VALUES))
        assert limit // len(chunks) <= 1  # some chunk has one error at most


def test_contamination(spark, docs, rows, empty):
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) > 30]
    alnum = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    passage = texts[0].split()[5:25]
    items = [(1, " ".join(passage).upper()), (2, ", ".join(passage[3:15])), (3, "one"), (4, None), (5, " -- "), (None, "two words"),
             (11, " ".join(passage)), (7, "never " * 12), (8, " ".join(texts[1].split()[:4]))]
    frame = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, doc_id string")

    def tokens(t):
        return alnum.findall((t or "").translate(LOW))

    windows = {}
    for item, text in items:
        w = tokens(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    want = {}
    for r in rows:
        w, hit, ids = tokens(r[1]), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    ids |= windows[tuple(w[i:i + n])]
        want.setdefault(r[0], set()).add((len(w), len(hit), tuple(sorted(str(x) for x in ids if x is not None))))
    got = {}
    for r in contamination(docs, frame).collect():
        got.setdefault(r.doc_id, set()).add((r.n_words, r.n_hit, tuple(r.item_ids)))
    assert got == want and any(x[1] for s in want.values() for x in s)
    clean = keep_clean(docs, frame)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not any(x[1] for x in want[r[0]]) for r in rows)
    none = spark.createDataFrame([], frame.schema)
    assert keep_clean(docs, none).count() == len(rows) and contamination(empty, frame).count() == 0


def test_repeats(spark, docs, rows, empty):
    def reference(table, depth):
        first = {}
        for doc, text in table:
            data = (text or "").encode()
            for p in range(len(data) - depth + 1):
                at = (order(doc), p)
                s = data[p:p + depth]
                if s not in first or at < first[s]:
                    first[s] = at
        out = {}
        for doc, text in table:
            data = (text or "").encode()
            gone = np.zeros(len(data), bool)
            for p in range(len(data) - depth + 1):
                if first[data[p:p + depth]] != (order(doc), p):
                    gone[p:p + depth] = True
            spans = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]])) if len(gone) else 0
            kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
            out.setdefault(doc, set()).add((len(data), int(gone.sum()), spans, sha(kept)))
        return out

    want = reference([(r[0], r[1]) for r in rows], 100)
    got = {}
    for r in remove_repeats(docs).collect():
        got.setdefault(r.doc_id, set()).add((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert got == want and sum(x[1] > 0 for s in want.values() for x in s) > 5
    rng = random.Random(3)
    period = "".join(rng.choices("abc", k=37)) * 20
    passage = "".join(rng.choices("abcdefgh ", k=130))
    odd = [(i, "".join(rng.choices("abcdefgh", k=rng.randint(0, 90))) + passage[rng.randint(0, 20):rng.randint(105, 130)]
            + "".join(rng.choices("abcdefgh", k=rng.randint(0, 90)))) for i in range(40)] + [(50, period), (51, "x" * 400), (52, period[7:300])]
    got = {r.doc_id: {(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)}
           for r in remove_repeats(spark.createDataFrame(odd, "doc_id long, text string").repartition(5)).collect()}
    assert got == reference(odd, 100)
    assert remove_repeats(empty).count() == 0


def test_warc_round_trip(spark, empty):
    big = "<p>é" + "x" * 200 + "</p>"
    pages = [(3, "http://a/ b\n", big), (1, "http://a/1", big), (2, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None),
             (7, "u", ""), (None, "u", big), (1, "http://a/1", big), (8, "u", "y" * 300_000)]
    frame = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    archives = write_archives(frame)
    got = sorted(map(repr, (tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in read_archives(archives).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").collect())))
    want = []
    for page, _, html in pages:
        data = (html or "").encode()
        revisit = html == big and page != 1
        want.append(repr((page, len(data), sha(data), "revisit" if revisit else "response", 1 if revisit else None,
                          None if revisit else data)))
    assert got == sorted(want)
    assert read_archives(write_archives(spark.createDataFrame([], frame.schema))).count() == 0


def test_warc_reader_refuses_damage():
    import io

    from maskwright.llm.warc import BadArchive, read_records, record

    one = record(1, "u", b"payload" * 50, None, "d", False)
    two = record(2, "u", b"", None, "d", False)
    assert [b[0]["warc-record-id"] for b in read_records(io.BytesIO(one + two))] == ["<urn:page:1>", "<urn:page:2>"]
    damaged = zlib.decompress(one, 31).replace(b"payloadpay", b"payloAdpay")
    zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
    for bad in (one[:-9], one[:40] + bytes([one[40] ^ 255]) + one[41:], zipped.compress(damaged) + zipped.flush()):
        with pytest.raises(BadArchive):
            list(read_records(io.BytesIO(bad)))


def test_token_files(docs, rows, empty):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = sorted((tuple(r) for r in read_back(*encode_to_files(docs, path, 1)).collect()), key=lambda r: r[1])
    at, want = 0, []
    for r in sorted(rows, key=lambda r: (order(r[0]), r[1] or "")):
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    documents, files = encode_to_files(empty, path, 1)
    assert read_back(documents, files).count() == 0


def test_samples_are_distinct_and_decode(docs, rows, empty):
    from sentencepiece import SentencePieceProcessor

    model = tokenizer_file("piece_bpe_32k.model")
    processor = SentencePieceProcessor(model_file=model)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).add(r[1] or "")
    by_id = {}
    for r in encode_samples(docs, model, k=3).collect():
        assert r.decoded
        ids = [tuple(s.ids) for s in r.samples]
        assert len(set(ids)) == len(ids) <= 3
        assert {processor.decode(list(x)) for x in ids} <= texts[r.doc_id]
        assert all(s.log_prob <= 1e-9 and s.log_inclusion <= 0 for s in r.samples)
        assert by_id.setdefault(r.doc_id, ids) == ids  # equal rows, equal samples
    again = {r.doc_id: [tuple(s.ids) for s in r.samples] for r in encode_samples(docs.repartition(7), model, k=3).collect()}
    assert again == by_id
    assert encode_samples(empty, model).count() == 0


def test_samples_follow_the_distribution():
    import pyarrow as pa

    from maskwright.llm.pieces import Vocabulary, sample
    from maskwright.llm.texts import mix

    vocabulary = Vocabulary(tokenizer_file("piece_bpe_32k.model"))
    text = "thand a"
    pieces = {p: i for i, p in enumerate(vocabulary.bytes) if p and i > 258}

    def paths(data):
        if not data:
            yield ()
        for j in range(1, len(data) + 1):
            if data[:j] in pieces:
                yield from ((pieces[data[:j]], *rest) for rest in paths(data[j:]))

    every = list(paths(b" " + text.encode()))
    logs = np.array([vocabulary.logp[list(p)].sum() for p in every])
    p = np.exp(logs - np.logaddexp.reduce(logs))
    n = 6000
    found = sample(vocabulary, pa.array([text] * n), mix(np.arange(n).astype(np.uint64)), 2)
    place = {x: i for i, x in enumerate(every)}
    for turn, expected in ((0, p), (1, [sum(p[j] * p[i] / (1 - p[j]) for j in range(len(p)) if j != i) for i in range(len(p))])):
        seen = np.bincount([place[tuple(f[turn][0].tolist())] for f in found], minlength=len(p)) / n
        assert np.abs(seen - expected).max() < 4 * math.sqrt(0.25 / n)
    weights = np.mean([sum(math.exp(s[1] - s[2]) for s in f) for f in found])
    assert abs(weights - 1) < 0.05  # inclusion scores make sums unbiased


def test_language_model(spark, docs, rows, empty):
    got = {}
    for r in score_documents(docs, Settings(rounds=1)).collect():
        got.setdefault(r.doc_id, []).append(r)
    held = {r[0]: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows}
    tokens = [(r[0], [*words(r[1]), None]) for r in rows]
    counts = Counter(w for i, ws in tokens for w in ws if not held[i])
    total, types = sum(counts.values()), len(counts)
    for i, ws in tokens:
        base = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in ws)
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), total)
                   and abs(r.base_score - base) < 1e-6 * len(ws) and r.score < 0 for r in got[i])
    assert score_documents(empty).count() == 0
    alone = spark.createDataFrame([(i, "a b c") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert all(r.base_score == 0 and r.train_tokens == 0 for r in score_documents(alone).collect())


def test_language_model_learns_order(spark):
    rng = random.Random(2)
    names = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(1500):
        at, out = rng.randrange(40), []
        for _ in range(60):
            out.append(names[at])
            at = (at * 7 + 3) % 40 if rng.random() < 0.9 else rng.randrange(40)
        texts.append(" ".join(out))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    scored = [r for r in score_documents(frame, Settings(lanes=32, rounds=3)).collect() if r.held_out]
    assert sum(r.score for r in scored) > 0.75 * sum(r.base_score for r in scored)


def test_language_model_is_a_distribution():
    from maskwright.llm.gated_model import HEAD, HEAD_CLASSES, SYMBOLS, Model

    model = Model(Settings())
    model.start_at(np.arange(HEAD, 0, -1), np.ones(SYMBOLS - HEAD))
    hidden = np.random.default_rng(0).normal(size=(1, model.h)).astype(np.float32)
    logp = model.output(np.repeat(hidden, SYMBOLS, axis=0), np.arange(SYMBOLS), None)
    assert HEAD_CLASSES and abs(np.exp(logp.astype(np.float64)).sum() - 1) < 1e-4


def test_language_model_knows_every_counted_word(spark):
    """More words than have symbols: two words of one band, exchanged, change a text's score."""
    common = " ".join(f"c{i}" for i in range(1100))
    rare = [f"r{i}" for i in range(120)]
    texts = [common] * 30 + [" ".join(rare)] * 5 + ["c1 r7 c2 c3 r90 c4 c5", "c1 r90 c2 c3 r7 c4 c5"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    scored = {r.doc_id: r for r in score_documents(frame, held_fold=8).collect()}
    one, other = scored[len(texts) - 2], scored[len(texts) - 1]
    assert one.base_score == pytest.approx(other.base_score) and abs(one.score - other.score) > 1e-4


def test_language_model_bands_are_distributions():
    from maskwright.llm.gated_model import BANDS, Model

    sizes = np.zeros(BANDS, np.int64)
    sizes[:6] = 1, 2, 3, 64, 1000, 1025
    model = Model(Settings(), in_bands=sizes)
    rng = np.random.default_rng(0)
    hidden = rng.normal(size=(1, model.h)).astype(np.float32)
    for learnt in (False, True):
        for band, n in enumerate(sizes[:6].tolist()):
            logp = model.within(np.repeat(hidden, n, axis=0), np.full(n, band), np.arange(n, dtype=np.uint32), learn=False)
            assert abs(np.exp(logp).sum() - 1) < 1e-4
            assert learnt or np.allclose(logp, -math.log(n), atol=1e-4)
            assert not learnt or n < 64 or len(set(logp.round(6).tolist())) > n / 2
        model.parts["nodes"][:] = rng.normal(size=model.parts["nodes"].shape)
    before = model.within(hidden, np.array([4]), np.array([17], np.uint32), learn=True)[0]
    assert model.within(hidden, np.array([4]), np.array([17], np.uint32), learn=False) > before


def test_language_model_learns_from_every_token():
    """A task of fewer tokens than half a window of full lanes, and the last ones of a larger task."""
    from maskwright.llm.gated_model import NONE, Model, train

    few = np.arange(300, dtype=np.int32) % 7
    model, start = Model(Settings()), Model(Settings())
    none = np.full(300, NONE, np.uint32)
    assert train(model, Settings(), iter([(few, none, np.array([100, 200]), np.arange(2))])) == 300
    assert not np.array_equal(model.flat[:model.dense], start.flat[:start.dense])


def test_language_model_learns_order_as_registered(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12000):
        at, out = rng.randrange(40), []
        for _ in range(60):
            out.append(f"w{at}")
            at = (at * 7 + 3) % 40 if rng.random() < 0.9 else rng.randrange(40)
        texts.append(" ".join(out))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    scored = [r for r in score_documents(frame).collect() if r.held_out]
    assert sum(r.score for r in scored) > 0.5 * sum(r.base_score for r in scored)


def test_own_names_in_the_table_do_not_clash(spark):
    names = ["__b_doc", "__B_KEY", "__b_n", "__b_map", "__lines", "__dense", "__gone_doc", "__gone_key", "__hit_doc", "__hit_key"]
    line = "This line is in all of the documents and has over forty characters"
    rows = [(i, f"{line}\nword{i} " + " ".join(f"w{i}x{k}" for k in range(30)), *range(len(names))) for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    item = spark.createDataFrame([(1, " ".join(f"w3x{k}" for k in range(12)))], "item_id long, text string")
    assert sum(line in r.text for r in drop_lines(frame).collect()) == 1 and drop_lines(frame).columns == frame.columns
    assert keep_one(frame).count() == 6 and keep_one(frame).columns == frame.columns
    clean = keep_clean(frame, item)
    assert {r.doc_id for r in clean.collect()} == {0, 1, 2, 4, 5} and clean.columns == frame.columns


def test_one_long_run_of_contamination(spark):
    """A document of one item from end to end: rows grow with its words, not with their square."""
    rng = random.Random(9)
    words_ = [f"w{rng.randint(0, 3000)}" for _ in range(20_000)]
    frame = spark.createDataFrame([(1, " ".join(words_)), (2, " ".join(words_[:40] + ["x"] + words_[15_000:15_009]))], "doc_id long, text string")
    item = spark.createDataFrame([(5, " ".join(words_))], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in contamination(frame, item).collect()}
    assert got == {1: (20_000, 20_000, ["5"]), 2: (50, 40, ["5"])}


def test_language_model_lays_no_more_places_than_tokens():
    """One long document beside many short ones: the lanes hold the tokens, not a rectangle as long as the longest lane."""
    import numpy as np

    from maskwright.llm import gated_model as gm

    sizes = np.r_[5000, np.full(400, 7)]
    symbols = np.arange(sizes.sum()) % gm.HEAD
    ranks = np.full(len(symbols), gm.NONE, np.uint32)
    laid = gm._lanes(symbols, ranks, sizes, np.arange(len(sizes)), 64, owners=True)
    assert laid.targets.size == laid.inputs.size == laid.owner.size == sizes.sum()
    assert sorted(laid.targets.tolist()) == sorted(symbols.tolist())
    assert laid.fresh.sum() == len(sizes)
    assert np.bincount(laid.owner).tolist() == sizes.tolist()
    settings = gm.Settings(hidden=4, lanes=64)
    model = gm.Model(settings)
    whole = gm.log_likelihood(model, settings, symbols, ranks, sizes)
    starts = np.cumsum(sizes) - sizes
    alone = [gm.log_likelihood(model, settings, symbols[a:a + n], ranks[a:a + n], np.array([n]))[0]
             for a, n in zip(starts[:5].tolist(), sizes[:5].tolist(), strict=True)]
    assert np.allclose(whole[:5], alone, rtol=1e-4)
