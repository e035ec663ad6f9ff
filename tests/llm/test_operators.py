"""Each operator on odd rows (nulls, blanks, long texts, ties, repeated rows, clashing names, no rows) and by brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import induced, langid, media, mixing, packing, pii, quality, queries, repeats, simhash, spans, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ly"]) + str(rng.randrange(60)) for _ in range(n)).capitalize() + "."


def texts(seed=1):
    rng = random.Random(seed)
    plain = [" ".join(sentence(rng, rng.randrange(5, 14)) for _ in range(rng.randrange(3, 9))) for _ in range(12)]
    shared = " ".join(sentence(rng, 12) for _ in range(6))
    near = [" ".join(w if k != 30 * i else "other" for k, w in enumerate(shared.split())) for i in range(1, 3)]
    mixed = [plain[0] + " " + shared, shared + " " + plain[1], plain[2] + "\n" + shared + "\n" + plain[3]]
    long = " ".join(sentence(rng, 10) for _ in range(800))
    odd = [None, "", " \t\n", "a", "a b c", "***", "é è 你好 🙂", "tab\tand  two   spaces", long, "x" * 3000, "same line\nsame line\nsame line\n" * 5, "\x02 odd\x00 bytes\x1c here"]
    return plain + [shared, *near, *mixed, plain[5], plain[5], *odd]


def rows():
    out = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}" if i % 7 else None, len(t) if t else None) for i, t in enumerate(texts())]
    return out + [out[0], (None, out[1][1], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(40)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


CLASH = ["key", "source_size", "target", "last", "whole", "fp", "of", "__fp", "__of", "mix", "quality", "base", "more", "fingerprint", "component_id", "length", "rank", "salt", "kept", "bucket"]


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASH)))


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- simhash ----


def test_simhash_brute_force(docs, spark):
    got = collected(simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id"))
    known = [(d, t) for d, t, *_ in rows() if d is not None]
    want = simhash.brute_force(known)
    mine = [r for r in got if r[0] is not None]
    assert mine == sorted(map(tuple, want.values.tolist()), key=repr) and len(got) == len(rows())


def test_simhash_digest_is_sparks(spark):
    r = spark.sql("select xxhash64('a b c d') h").first()[0]
    assert simhash.fingerprint(b"A b c D") == r & (2**64 - 1)


def test_meetings_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fp = np.unique(np.concatenate([c ^ sum(np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64) for _ in range(k)) for c in centre for k in (1, 2, 3)]))
    for most in (simhash.MAX_VARIANTS, 3000):  # the second splits a prefix by further bits
        monkeypatch.setattr(simhash, "MAX_VARIANTS", most)
        root = {int(f): int(f) for f in fp}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for batch in simhash._deal(__import__("pyarrow").table({"fp": fp.view(np.int64)}).to_batches(), 12, 2):
            t = __import__("pyarrow").Table.from_batches([batch])
            for prefix in np.unique(t["prefix"].to_numpy()):
                part = t.filter(__import__("pyarrow.compute").compute.equal(t["prefix"], prefix))
                for a, b in zip(*(simhash._link(part, 12, 4).column(k).to_numpy().view(np.uint64).tolist() for k in "ab"), strict=True):
                    root[find(a)] = find(b)
        want = {int(f): int(f) for f in fp}

        def known(x):
            while want[x] != x:
                x = want[x]
            return x

        for i, a in enumerate(fp.tolist()):
            for b in fp.tolist()[i + 1 :]:
                if (a ^ b).bit_count() <= 4:
                    want[known(a)] = known(b)
        groups = lambda f: sorted(sorted(x for x in want if f(x) == r) for r in {f(x) for x in want})  # noqa: E731, B023
        assert groups(find) == groups(known)


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102)], "a long, b long")
    got = dict(simhash.components(edges).collect())
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}
    assert simhash.components(edges.limit(0)).count() == 0


def test_representatives(docs, clashing, none):
    want = {}
    for d, t, *_ in rows():
        want.setdefault(simhash.fingerprint((t or "").encode()), d)
    kept = simhash.representatives(docs).collect()
    assert len({r.doc_id for r in kept}) == len(kept) and {r.doc_id for r in kept} <= {d for d, *_ in rows()}
    comp = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r.doc_id for r in kept) == sorted(set(comp.values()))
    assert simhash.representatives(clashing).columns == clashing.columns
    assert simhash.representatives(none).count() == 0


def test_simhash_hot_prefixes(spark):
    """Links are the same when prefixes are dealt out again by further bits."""
    rng = random.Random(2)
    base = [rng.getrandbits(64) >> 20 for _ in range(40)]  # one prefix holds all
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) for b in base for _ in range(8)})
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long").repartition(3)

    def classes(most):
        root = {int(np.uint64(f).view(np.int64)): f for f in fps}
        pairs = [(r.a, r.b) for r in simhash.links(df, most=most).collect()]
        while any(root[a] != root[b] for a, b in pairs):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    want = simhash.brute_links(fps)
    assert classes(10**9) == classes(20) == {int(np.uint64(f).view(np.int64)): r for f, r in want.items()}


def test_representatives_of_repeated_and_missing_ids(spark):
    """Unlike texts under one id stay both; near copies without ids keep one."""
    rng = random.Random(12)
    a, b, c = (sentence(rng, 300) for _ in range(3))
    near = next(t for t in (c.replace(w, "other", 1) for w in c.split()) if 1 <= (simhash.fingerprint(t.encode()) ^ simhash.fingerprint(c.encode())).bit_count() <= 4)
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (None, c), (None, near)], "doc_id long, text string")
    kept = sorted((r.doc_id is None, r.text in (a,), r.text in (b,), r.text in (c, near)) for r in simhash.representatives(df).collect())
    assert kept == [(False, False, True, False), (False, True, False, False), (True, False, False, True)]


# ---- language ----


def test_language_held_out(spark):
    rng = random.Random(3)
    parts = {"aa": ["ka", "ti", "lo", "mu"], "bb": ["sch", "rei", "ung", "ver"], "cc": ["eau", "ieux", "ment", "tre"]}
    made = [(i, lang, " ".join("".join(rng.choice(p) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(8, 60)))) for i in range(300) for lang, p in [rng.choice(list(parts.items()))]]
    df = spark.createDataFrame([(i, t, lang) for i, lang, t in made], "doc_id long, text string, lang string")
    model = langid.learn(df.where(~langid.held_out(F.col("doc_id"))))
    got = df.select("doc_id", "lang", langid.held_out(F.col("doc_id")).alias("h"), langid.identify(df, model).alias("p")).collect()
    held = [r for r in got if r.h]
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang == r.p.lang_pred for r in held) / len(held) > 0.95 and all(0 <= r.p.score <= 1 for r in got)


def test_language_odd_rows(docs, none):
    model = langid.learn(docs)
    got = docs.select("text", langid.identify(docs, model).alias("p")).collect()
    assert all((r.p.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text)) for r in got)
    empty = langid.learn(none)
    assert {r.p.lang_pred for r in docs.select(langid.identify(docs, empty).alias("p")).collect()} == {"und"}


def test_phrases_by_brute_force():
    model = langid.Model({"a": ["banana bandana"], "b": ["ananas"]})
    trained = {k: model.encode(v).astype("u1").tobytes() for k, v in (("a", "banana bandana"), ("b", "ananas"))}
    for t in ("banana", "nab band xyz", "ananasananas"):
        codes = model.encode(t)

        def count(text, code):
            n, at = 0, 0
            while at < len(code):
                k = 1
                while at + k < len(code) and code[at : at + k + 1] in text:
                    k += 1
                n, at = n + 1, at + k
            return n

        assert model.phrases([codes])[0].tolist() == [count(trained[k], codes.astype("u1").tobytes()) for k in "ab"]


def test_language_large_scripts(spark):
    """Scripts of hundreds of letters, some shared by two languages; a long text is parsed as one."""
    rng = random.Random(6)

    def language(first, n):
        words = ["".join(chr(first + rng.randrange(n)) for _ in range(rng.randint(1, 4))) for _ in range(1500)]
        return lambda k: " ".join(rng.choice(words) for _ in range(k))

    made = {"aa": language(0x4E00, 1500), "bb": language(0x4E00, 1500), "cc": language(0x5A00, 900), "dd": language(0xAC00, 400), "ee": language(0x430, 32), "ff": language(0x61, 26), "gg": language(0x61, 26)}
    model = langid.Model({k: [f(250) for _ in range(langid.ROWS)] for k, f in made.items()})
    assert all(len(edges) < 4 * 10**5 for _, edges in model.automata)
    asked = [(k, f(n)) for k, f in made.items() for n in (8, 20, 60) for _ in range(10)]
    found = model.predict([t for _, t in asked])
    assert sum(k == p for (k, _), (p, _) in zip(asked, found, strict=True)) / len(asked) > 0.95
    long = [model.encode(f(4000)) for f in made.values()]
    blocks = model.phrases(long)
    whole = np.array([[phrases_of(model, k, t) for k in range(len(made))] for t in long])
    assert (abs(blocks - whole) <= 2).all()


def phrases_of(model, k, codes):
    bases, edges = model.automata[k]
    state = n = 0
    for c in codes.tolist():
        edge = int(edges[bases[state] + c])
        if edge >> 32 != state:
            n += 1
            edge = int(edges[bases[1] + c])
            edge = edge if edge >> 32 == 1 else 0
        state = edge & 0xFFFFFFFF
    return n


# ---- media ----


def test_media_round_trip(docs, none):
    for r in docs.select("text", media.round_trip(F.col("text")).alias("m"), media.stored(F.col("text")).alias("f")).collect():
        raw = (r.text or "").encode()
        payload = media.padded(raw)
        about = media.probe(bytes(r.f))
        assert len(payload) % 192 == 0 and payload[: len(raw)] == raw and media.payload(bytes(r.f), about) == payload
        assert r.m.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.m.tail_crc32 == zlib.crc32(payload[-16:]) and r.m.n_bytes == len(raw)
        assert about["duration"] == len(payload) and len(about["keyframes"]) == -(-len(payload) // 192 // 16) and r.m.media_bytes == len(r.f)
        assert all(bytes(r.f)[a : a + n] == payload[k * 16 * 192 : k * 16 * 192 + n] for k, (a, n) in enumerate(about["keyframes"].tolist()))
    assert none.select(media.round_trip(F.col("text"))).count() == 0


def plain_boxes(data, at=0, end=None):
    """(kind, content) of all boxes, those within moov, trak, mdia, minf and stbl included; read here by itself."""
    end = len(data) if end is None else end
    while at < end:
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        head = 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        assert head <= size <= end - at
        yield kind, data[at + head : at + size]
        if kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
            yield from plain_boxes(data, at + head, at + size)
        at += size
    assert at == end


def test_media_by_another_reader(docs):
    """Sample tables, offsets and samples as a reader written here finds them, against what the operator says it stored."""
    numbers = lambda b: [int.from_bytes(b[i : i + 4], "big") for i in range(0, len(b), 4)]
    for r in docs.select("text", media.round_trip(F.col("text")).alias("m"), media.stored(F.col("text")).alias("f")).collect():
        data, raw = bytes(r.f), (r.text or "").encode()
        boxes = dict(plain_boxes(data))
        size, count = numbers(boxes[b"stsz"][4:12])
        runs, offsets = numbers(boxes[b"stsc"][8:]), numbers(boxes[b"stco"][8:])
        out, sample = [], 0
        for chunk, at in enumerate(offsets, 1):
            n = next(runs[i + 1] for i in reversed(range(0, len(runs), 3)) if runs[i] <= chunk)
            out.append(data[at : at + n * size])
            sample += n
        payload = b"".join(out)
        assert sample == count and size == 192 and payload == boxes[b"mdat"] and payload.rstrip(b" ") == raw.rstrip(b" ") and payload.startswith(raw)
        assert numbers(boxes[b"stts"][8:]) == [count, 192] and numbers(boxes[b"stss"][8:]) == list(range(1, count + 1, 16))
        assert (r.m.media_sha256, r.m.media_bytes, r.m.payload_bytes) == (hashlib.sha256(data).hexdigest(), len(data), len(payload))


def test_media_foreign_and_broken(spark):
    moov_last = media.store(media.padded(b"hello" * 500))
    boxes = list(media.walk(moov_last))
    assert (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsz") in [b[0] for b in boxes]
    for bad in (None, b"", b"not a file", moov_last[:300], moov_last[:20] + b"\xff" * 40):
        assert media.probe(bad) is None
    df = spark.createDataFrame([(bytearray(moov_last),), (bytearray(b"xx"),), (None,)], "m binary")
    got = [r[0] for r in df.select(media.described(F.col("m"))).collect()]
    assert got[0].codec == "raw " and got[0].keyframes[0].length == 192 and got[1:] == [None, None]


# ---- repeats ----


def test_repeats_brute_force(docs, none):
    got = sorted(((r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in repeats.deduplicated(docs).collect()))
    assert got == sorted(repeats.brute_force([(t or "").encode() for _, t, *_ in rows()]))
    assert any(r[1] for r in got) and repeats.deduplicated(none).count() == 0


def repeated(strings, width):
    seen = {}
    for t in strings:
        for i in range(len(t) - width + 1):
            seen[t[i : i + width]] = seen.get(t[i : i + width], 0) + 1
    return [i <= len(t) - width and seen[t[i : i + width]] > 1 for t in strings for i in range(len(t))]


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_repeated_windows_in_memory_and_in_files(held):
    for seed in range(40):
        rng = random.Random(seed)
        base = [bytes(rng.choice(b"abcdef ") for _ in range(rng.randint(50, 700))) for _ in range(3)] + [b"=" * 700] * (seed % 4 == 0)
        strings = []
        for _ in range(rng.randint(1, 12)):
            b = bytearray(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                b[rng.randrange(len(b))] = rng.choice(b"abcxyz")
            a = rng.randint(0, len(b) // 2)
            strings.append(bytes(b[a : a + rng.randint(30, 600)]))
        for widths in ((400,), (64, 100), (256, 400), (30, 31)):
            got = repeats.repeated_windows(strings, widths, None, held)
            for k, width in enumerate(widths):
                assert (got >> k & 1).astype(bool).tolist() == repeated(strings, width), (seed, widths)


@pytest.mark.parametrize("held", [1 << 20, 7])
def test_induced_sorting(held):
    for seed in range(150):
        rng = random.Random(seed)
        text = [rng.randint(1, rng.randint(1, 6)) for _ in range(rng.randint(1, 200))] + [0]
        got = list(induced.sort(np.array(text, dtype=np.int64), None, held))
        assert [i for i, _ in got] == sorted(range(len(text)), key=lambda i: text[i:], reverse=True)
        for (a, _), (b, same) in zip(got, got[1:]):
            k = 0
            while text[a + k : a + k + 1] == text[b + k : b + k + 1] and max(a, b) + k < len(text):
                k += 1
            assert k == same


def test_repeats_hot_anchor_and_passages(spark):
    """A passage in many differing texts, with and without the split of its anchors; short passages of many words are told."""
    rng = random.Random(5)
    passage = " ".join(sentence(rng, 12) for _ in range(8))
    short = " ".join(str(rng.randrange(1000, 9999)) for _ in range(55))
    made = [sentence(rng, 30) + passage[rng.randrange(3) :] + sentence(rng, 40) for _ in range(40)] + [sentence(rng, 9) + short + sentence(rng, 9) for _ in range(2)]
    made += [sentence(rng, 200), made[0]]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    want = repeats.brute_force([t.encode() for t in made])
    for hot in (repeats.HOT, 3):
        got = {r.doc_id: r for r in repeats.deduplicated(df, hot=hot).collect()}
        assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, hashlib.sha256(got[i].kept).hexdigest()) for i in range(len(made))] == want
        assert [got[i].n_passages for i in range(len(made))] == [1] * 42 + [0, 1] and got[40].n_removed == 0


# ---- mixing ----


def filled(sizes, weights, most=3):
    total, left, target = sum(sizes.values()), dict(weights), {}
    rest = float(total)
    while left:
        share = {k: rest * w / sum(left.values()) for k, w in left.items()}
        over = [k for k in left if share[k] > most * sizes[k]]
        if not over:
            return target | share
        for k in over:
            target[k] = float(most * sizes[k])
            rest -= target[k]
            del left[k]
    return target


def test_mixing_targets_and_takes(docs, clashing, none):
    got = mixing.mix(docs, keep_text=True).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in got:
        assert r.mix.size == count(r.text) and r.mix.taken <= 3 * r.mix.size
        sizes[r.source] = sizes.get(r.source, 0) + r.mix.size
    order = sorted(s for s in sizes if s) + [None]
    want = filled(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    largest = max(r.mix.size for r in got)
    for s in sizes:
        own = [r.mix for r in got if r.source == s]
        assert own[0].target == pytest.approx(want[s]) and own[0].source_size == sizes[s]
        assert abs(sum(m.taken for m in own) - want[s]) <= largest
    again = mixing.mix(docs.repartition(5), keep_text=True).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and mixing.mix(none).count() == 0
    assert mixing.repeated(clashing).columns == clashing.columns
    assert mixing.repeated(docs).count() == sum(r.mix.repeats for r in got)


# ---- quality ----


def test_quality_base(docs, labels, clashing, none):
    for r in quality.judged(docs, labels, keep_text=True).collect():
        t = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        hit = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)} if len(windows) < 2000 else None
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        assert hit is None or q.n_repeat_words == len(hit)
        assert q.base_failed == (len(words) < 10 or 100 * q.n_repeat_words > 20 * len(words)) and (not q.kept or not q.base_failed)
    assert quality.accepted(clashing, labels).columns == clashing.columns and quality.accepted(none, labels).count() == 0
    assert quality.judged(docs, labels.limit(0)).count() == len(rows())


def test_quality_bound_and_cutoffs():
    from math import comb

    for k, n in ((0, 50), (3, 200), (10, 90)):
        p = quality.upper_bound(k, n, 0.05)
        assert sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(0.05, rel=1e-6)
    assert quality.upper_bound(0, 0, 0.05) == 1.0 and quality.upper_bound(5, 5, 0.05) == 1.0
    assert quality.certified([("en", 3, 5000, 100), ("en", 1, 0, 400), ("en", 2, 30, 90)], 2) == {"en": 2, None: 0}
    assert quality.certified([("en", 2, 50, 10), ("en", 1, 0, 40)], 1)["en"] == 0  # too few to be sure
    few = [(k, step, 60 * (step == 2), 9 * (step == 1)) for k in "abcd" for step in (1, 2)]  # together they are enough
    assert quality.certified(few, 1) == dict.fromkeys([*"abcd", None], 1) and quality.certified(few[:4], 1)["a"] == 0
    assert quality.certified([("en", 1, 900, 500), ("en", 2, 4100, 0)], 1)["en"] == 0 and quality.certified([], 0) == {None: 0}
    assert quality.path(np.zeros((0, 7), dtype=np.int64), np.zeros(0, dtype=np.int64)) == []


def test_quality_guarantee(spark):
    rng = random.Random(4)
    made = []
    for i in range(4000):
        bad = i % 5 == 0
        made.append((i, " ".join(rng.choice(WORDS) + str(rng.randrange(99)) + ("***" if bad and rng.random() < 0.8 else "") for _ in range(30)), "en", "s", 0))
    df = spark.createDataFrame(made, SCHEMA)
    lab = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 4000)], "doc_id long, quality int")
    got = quality.judged(df, lab).collect()
    assert sum(not r.quality.kept for r in got if r.doc_id % 5 == 0) > 700 and sum(not r.quality.kept for r in got if r.doc_id % 5) <= 0.02 * 3200


def draws_of(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "i long")
    return {r.i: r.h / 2.0**64 + 0.5 for r in df.selectExpr("i", f"xxhash64({quality.SEED}, cast(i as string)) h").collect()}


def verdicts(fields, good, lang, draws):
    """(path, first step that rejects each id, step used for each language), by the rules of the docstring."""
    from math import comb

    def scores(q):
        n, c = max(q["n_words"], 1), max(q["word_chars"], 1)
        return [q["n_symbols"] / c, q["n_upper"] / c, q["n_marks"] / c, q["n_dup_lines"] / max(q["n_lines"], 1), q["n_repeat_words"] / n, min(q["word_chars"] / n / 32, 1), 1 - min(q["word_chars"] / n / 16, 1)]

    bins = {i: [int(np.floor(np.sqrt(x) * 64)) for x in scores(q)] for i, q in fields.items()}
    good = {i: g for i, g in good.items() if i in fields and fields[i]["n_words"]}
    tune, cuts, steps, lost = [i for i in good if draws[i] < 0.2], [99] * 7, [], 0
    while True:
        live = [i for i in tune if all(b < c for b, c in zip(bins[i], cuts, strict=True))]
        options = []
        for r in range(7):
            for b in range(64, 0, -1):
                hit = [good[i] for i in live if bins[i][r] >= b]
                options.append((len(hit) - sum(hit), sum(hit), -r, b))
        bad, fine, r, b = max((o for o in options if o[0] >= 2), key=lambda o: (o[0] / (o[1] + 1), o[0], o[2], o[3]), default=(0, 0, 0, 0))
        if not bad or lost + fine > 0.06 * sum(good[i] for i in tune) or len(steps) == quality.STEPS:
            break
        cuts[-r], lost = b, lost + fine
        steps.append((-r, b))
    first = {i: next((k for k, (r, b) in enumerate(steps, 1) if x[r] >= b), len(steps) + 1) for i, x in bins.items()}
    held = [i for i in good if draws[i] >= 0.2]
    own = {k: [i for i in held if lang[i] == k] for k in {lang[i] for i in held}}
    needed = np.ceil(np.log(0.05 / len(own)) / np.log(0.98)) if own else 0
    few = [k for k in own if sum(good[i] for i in own[k]) < needed]
    strata = [[k] for k in own if k not in few] + ([few] if few else [])
    used = {}
    for names in strata:
        ids = sum((own[k] for k in names), [])
        fine, bad = ([first[i] for i in ids if good[i] == g] for g in (1, 0))
        best, at = 0, 0
        for step in range(1, len(steps) + 1):
            x = sum(s <= step for s in fine)
            if sum(comb(len(fine), j) * 0.02**j * 0.98 ** (len(fine) - j) for j in range(x + 1)) > 0.05 / len(strata):
                break
            gain = sum(s <= step for s in bad) / max(1, len(bad)) - 10 * x / max(1, len(fine))
            if gain > best:
                best, at = gain, step
        used |= dict.fromkeys(names, at)
    return steps, first, used


def made_for_quality(rng, n):
    made, good = [], {}
    for i in range(n):
        bad = rng.random() < 0.25
        words = [rng.choice(WORDS) + str(rng.randrange(99)) + ("#|" if bad and rng.random() < 0.3 else "" if rng.random() < 0.998 else "$") for _ in range(rng.randrange(12, 40))]
        made.append((i, (" SHOUT" * 9 if bad and i % 3 else "") + " ".join(words), ("en", "fr", None)[min(2, i % 40 // 18)], f"s{i % 3}", 0))
        good[i] = int(not bad)
    return made, good


def test_quality_kept_brute_force(spark):
    """The verdict on every row against the path and the binomial tests worked out here, three languages, one small."""
    made, good = made_for_quality(random.Random(8), 3300)
    lab = [(i, g if i % 11 else None) for i, g in good.items()]
    df = spark.createDataFrame(made, SCHEMA).repartition(3)
    got = {r.doc_id: r.quality for r in quality.judged(df, spark.createDataFrame(lab, "doc_id long, quality int")).collect()}
    steps, first, used = verdicts({i: q.asDict() for i, q in got.items()}, {i: g for i, g in lab if g is not None}, {i: k or "" for i, _, k, *_ in made}, draws_of(spark, good))
    assert used["en"] > 0 and used["fr"] > 0 and used[""] == 0
    for i, _, k, *_ in made:
        gone, q = first[i] <= used[k or ""], got[i]
        assert q.kept == (not q.base_failed and not gone) and q.rule == (list(quality.RULES)[steps[first[i] - 1][0]] if gone else None)
    assert sum(not got[i].kept for i in good if not good[i]) > 400


# ---- sentence spans ----


def brute_spans(items):
    seen, out = {}, {}
    for d, t in sorted(set(items), key=lambda x: x[0]):
        b = (t or "").encode()
        places = spans.sentences(b)
        for h, i, j in spans.runs(b, places):
            seen.setdefault(h, []).append((d, i, j))
    gone = {}
    for at in seen.values():
        for d, i, j in sorted(at)[1:]:
            gone.setdefault(d, set()).update(range(i, j))
    for d, t in items:
        b = (t or "").encode()
        out[d] = b"".join(b[a:z] for k, (a, z) in enumerate(spans.sentences(b)) if k not in gone.get(d, ())).decode()
    return out


def test_spans_brute_force(docs, none):
    known = docs.where("doc_id is not null")
    want = brute_spans([(d, t) for d, t, *_ in rows() if d is not None])
    got = spans.deduplicated(known).collect()
    assert {r.doc_id: r.kept or "" for r in got} == want and any(r.n_removed for r in got)
    assert all(b"".join(t[a:z] for a, z in spans.sentences(t)) == t for t in ((x or "").encode() for x in texts()))
    assert spans.deduplicated(docs).count() == len(rows()) and spans.deduplicated(none).count() == 0


def test_spans_whole_passages(spark):
    """Against all passages of whole sentences that are long enough, enumerated here; copies go whole."""
    rng = random.Random(7)
    tail = sentence(rng, 14) + " " + sentence(rng, 9) + " Short end. Bye."
    one, few = sentence(rng, 20), "Three words only."
    made = [tail, sentence(rng, 13) + " " + tail, tail + " " + sentence(rng, 30), one, sentence(rng, 3) + " " + one + " " + sentence(rng, 4), few, "Other few words.", " \n" + one, "", None]
    made += [" ".join(rng.choice(("A b c d.", "E f g.", "H i j k l!", "M n o p q r s t u v w x y z.")) for _ in range(rng.randrange(1, 9))) for _ in range(30)]
    items = list(enumerate(made + made[:6]))
    seen, cut, gone = {}, {}, {}
    for d, t in items:
        raw = (t or "").encode()
        cut[d] = [raw[a:z] for a, z in spans.sentences(raw)]
        words = [x.split() for x in cut[d]]
        first = int(len(words) > 1 and not words[0])
        for i in range(first, len(words)):
            for j in range(i + 1, len(words) + 1):
                run = sum(words[i:j], [])
                if len(run) >= 12 or run and i == first and j == len(words):
                    seen.setdefault((tuple(run), len(run) < 12), []).append((d, 0 if i == first else i, j))
    for at in seen.values():
        for d, i, j in sorted(at)[1:]:
            gone.setdefault(d, set()).update(range(i, j))
    want = {d: b"".join(x for k, x in enumerate(cut[d]) if k not in gone.get(d, ())).decode() for d, _ in items}
    got = {r.doc_id: r.kept or "" for r in spans.deduplicated(spark.createDataFrame(items, "doc_id long, text string")).collect()}
    assert got == want and all(got[d] == "" for d in range(len(made), len(items)))


def test_sentences_in_linear_time():
    import time

    for c in (".", " ", '"', ".'", "\n", "!? ", "。", ". \n", "?!'\t"):
        t = time.time()
        text = (c * (1_000_000 // len(c)) + "x").encode()
        assert b"".join(text[a:z] for a, z in spans.sentences(text)) == text
        assert time.time() - t < 5, c
    text = "一。 “Two” – three… é.\nFour"
    assert [text.encode()[a:z].decode() for a, z in spans.sentences(text.encode())] == ["一。 ", "“Two” – three… é.\n", "Four"]


# ---- personal data ----

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def plain_spans(t):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


PII = [
    "mail a.b@c.com, a_b@d.e_f@g.h x@y @z.com a@b..c é@é.com",
    "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.255 999999999999999999999.1.1.1 1..2.3.4",
    "card 4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 5 " + "1" * 40,
    "phone +1 (499) 555-6503 +84 90 123 4567. +1 23 +44(20)7946-0958) ++1 2345678901",
    "🙂 4111 1111 1111 1111 🙂 x@y.zz +1 (499) 555-6503 10.0.0.1",
    "1" * 5000 + " " + "a" * 5000 + "@" + "b." * 3000 + "c",
    "@@@ + ++ . .. 1.1.1", "", None,
]


def test_pii_base(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PII)] + [(0, PII[0]), (None, PII[3])], "doc_id long, text string")
    got = pii.found(df, keep_text=True).collect()
    assert len(got) == len(PII) + 2
    for r in got:
        assert [(s.start, s.kind, s.end) for s in r.base] == plain_spans(r.text or ""), r.text


def test_pii_terms(spark, docs, clashing, none):
    filler = [f"the usual words of report number{i} are here and there" for i in range(60)]
    told = [f"please ask Zanzibar at secret@agent.org about the usual words {i}" for i in range(4)]
    df = spark.createDataFrame(list(enumerate(filler + told)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.found(df).collect()}
    for i, t in enumerate(told):
        more = [t[s.start : s.end] for s in got[60 + i].more]
        assert "Zanzibar" in more and "words" not in more
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert "[EMAIL]" in clean[60] and "Zanzibar" not in clean[60] and clean[0] == filler[0]
    once = spark.createDataFrame(list(enumerate(filler + ["contact gardener via bob@example.org quickly"] * 3)), "doc_id long, text string")
    assert not any(r.more for r in pii.found(once).collect())  # what a text and its copies say reveals nothing of itself
    assert pii.sanitised(clashing).columns == clashing.columns and pii.found(none).count() == 0
    assert pii.found(docs).count() == len(rows())


def brute_terms(all_texts):
    """Of each text (start, kind, end) of the terms that reveal one of its entities."""

    def terms(t):
        for a, _, z in plain_spans(t):
            t = t[:a] + " " * (z - a) + t[z:]
        return [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]\w*", t)]

    n_t, n_te, n_e, within = {}, {}, {}, {}
    for k, t in enumerate(all_texts):
        held = [t[a:z] for a, _, z in plain_spans(t)]
        if held and t in all_texts[:k]:
            continue  # copies of a text with entities count once
        for e in held:
            n_e[e] = n_e.get(e, 0) + 1
        for w, *_ in terms(t):
            n_t[w] = n_t.get(w, 0) + 1
            for e in set(held):
                n_te[w, e] = n_te.get((w, e), 0) + 1
                within.setdefault((w, e), set()).add(t)
    total = sum(n_t.values())
    share = {(w, e): 1 - np.log(n_t[w] / n) / np.log(max(total / n_e[e], np.e)) for (w, e), n in n_te.items() if len(within[w, e]) > 1}
    out = []
    for t in all_texts:
        held = {t[a:z] for a, _, z in plain_spans(t)}
        best = [(a, max((share.get((w, e), 0) for e in held), default=0), z) for w, a, z in terms(t)]
        out.append([(a, 5 if x >= 0.99 else 4, z) for a, x, z in best if x >= 0.9])
    return out


def brute_masked(t, more):
    out, at = "", 0
    for a, kind, z in sorted(plain_spans(t) + more):
        if a >= at:
            said = t[a:z]
            general = "[CODE]" if re.search(r"\d", said) else "[NAME]" if said[0].isupper() else "[TERM]"
            out += t[at:a] + ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", general, "")[kind]
        at = max(at, z)
    return out + t[at:]


def test_pii_terms_anywhere(spark):
    """A told term goes wherever it stands in a text with the entity, whatever its length; brute force over the corpus."""
    gap = " the usual words of a report are here and there" * 3
    filler = [f"{gap} {i} at on Bob ask or" for i in range(200)]
    told = [f"Kim, 李明 {i}{gap} ask kim@agent.org or +1 (499) 555-6503 {i}\n{gap} Kim\tZANZIBAR 🙂 Ng" for i in range(4)]
    other = ["Bob wrote to bob@x.org", "Ng alone, without an address"]
    all_texts = filler + told + other + [told[0]]
    df = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in pii.found(df).collect()}

    for i, more in enumerate(brute_terms(all_texts)):
        assert [(s.start, s.kind, s.end) for s in got[i].more] == more, all_texts[i]
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert not re.search("Kim|李明|ZANZIBAR", clean[200] + clean[206]) and "usual words" in clean[200] and clean[205] == other[1]


# ---- packing ----


def test_packing(docs, clashing, none):
    path = queries.tokenizer_path()
    got = packing.packed(docs, path, capacity=256, with_ids=True).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    want = []
    for d, text, *_ in rows():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(d, k, a, np.array(ids[a : a + 256], "<u4").tobytes()) for k, a in enumerate(range(0, len(ids), 256))]
    assert sorted(((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in got), key=repr) == sorted(want, key=repr)
    by = {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.length == len(r.ids) // 4
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= -(-sum(r.length for r in got) // 256) + 2
    assert packing.packed(none, path).count() == 0 and packing.packed(clashing, path).count() > 0


def test_merges_are_the_tokenizers():
    from tokenizers import Tokenizer

    from quillgrid.llm.merges import LONGEST, Merges

    path = queries.tokenizer_path()
    real, rng = Tokenizer.from_file(path), random.Random(3)
    words = {"".join(rng.choice("aaeeinrstthoßéñçü") for _ in range(rng.randint(1, 16))) for _ in range(3000)} | {"a", "aaa", "a" * LONGEST, "ŉſĸ", "ªº"}
    words = [w.encode() for w in words if packing.whole_letters(w.encode())]
    got = Merges(path).encode(words)
    assert len(words) > 2500 and set(got) == set(words) and Merges(path).encode([]) == {}
    assert all(got[w] == np.array(real.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes() for w in words)
    assert not any(map(packing.whole_letters, (b"", b"a" * (LONGEST + 1), b"Ab", "É".encode(), "e\u0301".encode(), "日".encode(), b"a.")))
    texts = ["".join(rng.choice("abcXYZ éÉßñ'.,!12 \u0301ʰİ ﬁ日\x02<|>") for _ in range(rng.randint(0, 60))) for _ in range(500)] + [""]
    ids = packing.WordIds(path).encode_all([t.encode() for t in texts])
    assert ids == [np.array([*real.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts]


def test_other_tokenizers_are_asked_for_whole_texts():
    from tokenizers import Tokenizer

    other = queries.tokenizer_path().replace("word_bpe_49k", "byte_bpe_50k")
    words, real = packing.WordIds(other), Tokenizer.from_file(other)
    assert not words.by_word and packing.WordIds(queries.tokenizer_path()).by_word
    for t in (*packing.PROBES, "some  more words"):
        assert words.encode_all([t.encode()]) == [np.array([*real.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()]


def test_plan_fills_exactly():
    rng = random.Random(2)
    counts = {}
    for _ in range(5000):
        n = rng.randrange(1, 2049)
        counts[n] = counts.get(n, 0) + 1
    plan = packing.plan(dict(counts))
    used = {}
    for lengths, times in plan:
        assert sum(lengths) <= 2048 and times > 0
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == counts and sum(t for _, t in plan) <= 1.02 * sum(n * c for n, c in counts.items()) / 2048 + 1
    assert packing.plan({}) == [] and packing.plan({2048: 7}) == [((2048,), 7)]
    assert packing._fill(10, np.array([0, 0, 0, 2, 1] + [0] * 10)) == (4, 3, 3) and packing._fill(10, np.array([0, 0, 0, 1, 1] + [0] * 10)) is None


# ---- archives ----


def test_warc(spark, tmp_path):
    html = ["<p>one</p>", "<p>two</p>", "<p>one</p>", None, "", "\r\n\r\nWARC/1.1\r\n\r\n", "é 你好", "<p>one</p>", "x" * 100_000]
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\nEvil: 1" if i == 1 else f"http://x/{i}", h) for i, h in enumerate(html)] + [(7, "http://x/7", "<p>one</p>"), (None, None, "<p>two</p>")], "page_id long, url string, html string")
    got = warc.deduplicated(pages).collect()
    import base64

    assert len(got) == 11
    largest = {}
    for i, h in enumerate(html):
        largest[h or ""] = max(largest.get(h or "", -1), i)
    for r in got:
        h = "<p>two</p>" if r.id is None else html[r.id] or ""
        assert r.payload_bytes == len(h.encode()) and r.digest == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        first = r.id == largest[h]
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", largest[h]))
    path = warc.write(pages, str(tmp_path / "w"))
    raw = [f.read_bytes() for f in (tmp_path / "w").glob("part-*")]
    heads = [h for data in raw for h, _ in warc.parse(data)]
    assert all(re.fullmatch(r"20\d\d-\d\d-\d\dT[\d:]{8}Z", h["warc-date"]) for h in heads)
    assert len(heads) == 11 and len({h["warc-record-id"] for h in heads}) == 10 and not any("evil" in h for h in heads)
    assert warc.deduplicated(pages.limit(0)).count() == 0 and path.endswith("w")
    small = warc.deduplicated(pages.where("page_id is not null"), min_bytes=1).collect()
    assert sum(r.record_type == "response" and r.payload_bytes == 0 for r in small) == 2


def test_warc_odd_ids_and_large_pages(spark, monkeypatch):
    """Ids of any text come back; large pages have files of their own; clashing names are not read."""
    monkeypatch.setattr(warc, "LARGE", 50)
    monkeypatch.setattr(warc, "MOST_BYTES", 500)
    ids = ["", " pad ", "x\r\nEvil: 1", "é 你+%2B", None, "a", "b"]
    made = [(i, "u", "y" * (200 if k % 3 == 0 else 20) if k < 5 else "same", 1) for k, i in enumerate(ids)]
    got = warc.deduplicated(spark.createDataFrame(made, "page_id string, url string, html string, digest int").withColumn("original", F.lit(1)).withColumn("n_bytes", F.lit(2))).collect()
    assert sorted(map(repr, (r.id for r in got))) == sorted(map(repr, ids))
    assert {r.id: (r.record_type, r.refers_to) for r in got if r.id in ("a", "b")} == {"a": ("revisit", "b"), "b": ("response", None)}


# ---- pipeline ----


def test_pipeline_stages(spark, docs, labels, none, tmp_path):
    import corpus_pipeline as p

    for where, df in (("a", docs), ("b", none)):
        d = str(tmp_path / where)
        df.write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        held = spark.read.parquet(f"{d}/documents.parquet")
        for name, stage in p.STAGES:
            held = stage(spark, held, d)
            if name != p.STAGES[-1][0]:
                assert held.columns == docs.columns, name
        got = collected(p.run(spark, d).drop("sequence_id", "offset"))
        assert got == collected(held.drop("sequence_id", "offset")) and bool(got) == (where == "a")


def test_pipeline_brute_force(spark, tmp_path):
    """run()'s rows against all five stages worked out in Python, with labels enough for cutoffs, copies and entities."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    rng = random.Random(14)
    made, good = made_for_quality(rng, 1500)
    told = [f"please ask Zanzibar or Kim99 at secret@agent.org about the usual words " + " ".join(rng.choice(WORDS) + str(rng.randrange(999)) for _ in range(30)) for k in range(30)]
    made += [(1500 + k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(told)]
    made += [(1600 + k, made[30 * k + 7][1].replace(" ", "  ", k % 2), "en", "s0", 0) for k in range(40)] + [(1700, None, None, None, None), (1701, "few words", "en", None, 9)]
    spark.createDataFrame(made, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, g, 0) for i, g in good.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    fields = {i: dict(zip(quality.FIELDS, quality.measure((t or "").encode()), strict=True)) for i, t, *_ in made}
    lang = {i: k or "" for i, _, k, *_ in made}
    _, first, used = verdicts(fields, good, lang, draws_of(spark, lang))
    passes = lambda i, q: q["n_words"] >= 10 and 100 * q["n_repeat_words"] <= 20 * q["n_words"] and first[i] > used.get(lang[i], used.get("en", 0))
    docs = [r for r in made if passes(r[0], fields[r[0]])]
    assert any(used.values()) and len(docs) < len(made) - 100

    least = simhash.brute_force([(i, t) for i, t, *_ in docs]).component_id
    docs = [r for r, c in zip(docs, least, strict=True) if r[0] == c]
    more = brute_terms([t for _, t, *_ in docs])
    docs = [(i, brute_masked(t, m), s) for (i, t, _, s, _), m in zip(docs, more, strict=True)]
    assert sum("[EMAIL]" in t and "Zanzibar" not in t for _, t, _ in docs) == 30

    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in docs}
    sizes = {}
    for i, _, s in docs:
        sizes[s] = sizes.get(s, 0) + size[i]
    target = filled(sizes, {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))})
    taken = []
    for source in sizes:
        draw = {i: int(hashlib.md5(f"{mixing.SEED}:{i}:{t}".encode()).hexdigest()[:15], 16) for i, t, s in docs if s == source}
        whole = int(target[source] // sizes[source])
        rest, words = target[source] - whole * sizes[source], {}
        for i, d in draw.items():
            words[d % mixing.BUCKETS] = words.get(d % mixing.BUCKETS, 0) + size[i]
        last, before = mixing.BUCKETS, 0
        for k in sorted(words):
            if before + words[k] > rest:
                last = k
                break
            before += words[k]
        for i in sorted(draw, key=lambda i: (draw[i] % mixing.BUCKETS, draw[i], -size[i])):
            k = draw[i] % mixing.BUCKETS
            once = k < last or k == last and before + size[i] / 2 <= rest
            before += size[i] if k == last else 0
            taken += [i] * (whole + once)
    tokens, text, want = Tokenizer.from_file(queries.tokenizer_path()), {i: t for i, t, _ in docs}, []
    for i in taken:
        ids = [*tokens.encode(text[i], add_special_tokens=False).ids, 0]
        want += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    got = p.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(o == sum(n for x, n in places if x < o) for places in by.values() for o, _ in places) and max(sum(n for _, n in x) for x in by.values()) <= 2048
    assert len(by) <= 1.05 * sum(r.length for r in got) / 2048 + 1


ORACLE_TABLES = {"documents": SCHEMA, "pages": "page_id long, url string, html string", "labels": "doc_id long, quality int, toxic int"}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of small tables with odd texts and columns whose names clash with those of the operators."""
    where = str(tmp_path_factory.mktemp("small"))
    made = [r for r in rows()[:-3]]
    made += [(90 + k, t, "en", "s1", 1) for k, t in enumerate(x for x in PII if x is not None and len(x) < 5000)]
    made += [(200 + k, f"ask Zanzibar at secret@agent.org about the usual words {k} " + sentence(random.Random(k), 20), "fr", None, 1) for k in range(4)]
    docs = spark.createDataFrame(made, SCHEMA).select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASH)))
    docs.repartition(3).write.parquet(f"{where}/documents.parquet")
    html = ["<p>one</p>", "<p>two</p>", "<p>one</p>", None, "", "é 你好", "<p>one</p>", "x" * 100_000]
    spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(html)], ORACLE_TABLES["pages"]).withColumn("digest", F.lit(1)).withColumn("original", F.lit(2)).write.parquet(f"{where}/pages.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(40)], ORACLE_TABLES["labels"]).write.parquet(f"{where}/labels.parquet")
    return where


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, small, name):
    import duckdb

    c = duckdb.connect()
    for t in ORACLE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet/*.parquet')")
    got = queries.queries()[name](spark, small)
    found = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert collected(got.select(*names)) == sorted((tuple(r) for r in found.fetchall()), key=repr)


CONTRACT = {
    "op1": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2": "doc_id bigint, fingerprint string, component_id bigint",
    "op3": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op4": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op5": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op6": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op8": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op9": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op10": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
}


@pytest.mark.parametrize("op", sorted(CONTRACT))
def test_query_has_the_columns_of_its_contract(spark, small, op):
    (name,) = (k for k in queries.queries() if k.startswith(op + "_"))
    got = queries.queries()[name](spark, small)
    kinds = dict(got.dtypes)
    assert {k: kinds.get(k) for k in (x.split()[0] for x in CONTRACT[op].split(", "))} == dict(x.split() for x in CONTRACT[op].split(", "))
    assert got.count() >= spark.read.parquet(f"{small}/{'pages' if op == 'op10' else 'documents'}.parquet").count()
    texts = {r.doc_id: (r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    if op == "op1":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.collect())
    if op == "op2":
        want = simhash.brute_force(list(texts.items()))
        assert collected(got.select("doc_id", "fingerprint", "component_id")) == sorted(map(tuple, want.values.tolist()), key=repr)
    if op == "op3":
        for r in got.collect():
            raw = texts[r.doc_id].encode()
            payload = raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
            assert r.media_bytes > r.payload_bytes and re.fullmatch("[0-9a-f]{64}", r.media_sha256) and r.feature


def test_without_the_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for x in ("quillgrid", "__spark_entry__.py"):
        src = root / x
        shutil.copytree(src, tmp_path / x, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path / x)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.stdout.split()[2] == "False" and int(said.stdout.split()[0]) > 50, said.stderr
