"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from posegrid.llm import fingerprints, language_id, language_model, minhash, neighbours, packing, paragraphs, pieces, pii, suffix_dedup
from posegrid.llm.queries import tokenizer_file
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'é' * (rng.random() < 0.1)}" for _ in range(n))


def edited(rng, text, k):
    w = text.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


# --- near-duplicates ---------------------------------------------------------------------------


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(ids, texts):
    sets, parent = [shingles(t) for t in texts], {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(ids)), 2):
        inter = len(sets[a] & sets[b])
        if inter and 100 * inter >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(ids[a]), root(ids[b])))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in zip(ids, sets, strict=True)}


@pytest.mark.parametrize("block", [8 << 20, 2000])
def test_near_duplicates(documents, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", block)
    monkeypatch.setattr(minhash, "STAR", 3)
    rng = random.Random(5)
    base = [prose(rng, 60) for _ in range(6)]
    texts = [None, "", " \n\t ", "One two", "one TWO", "one two three four five", prose(rng, 30_000), "x" * 50_000]
    texts += base + [edited(rng, b, k) for b in base for k in (0, 1, 1, 2, 2, 3, 4)] + [base[0]] * 9 + [base[1].upper(), "  " + base[2].replace(" ", "\n")]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    got = minhash.dedup(documents(texts, ids)).toPandas()
    want = brute_components(ids, texts)
    assert len(got) == len(texts)
    for r in got.itertuples():
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_odd_rows(documents):
    assert minhash.dedup(documents([])).count() == 0
    got = minhash.dedup(documents(["a b c d e f"] * 3, [None, 4, 4])).toPandas()
    assert len(got) == 3 and got["component_id"].dropna().tolist() == [4, 4]


def test_near_duplicates_of_repeated_ids(documents):
    rng = random.Random(17)
    a, b = prose(rng, 56), prose(rng, 56)
    got = minhash.dedup(documents([a, b, f"{a} z", f"{b} z", b, None], [1, 1, 2, 3, 9, 1])).toPandas()
    assert got.groupby("doc_id")["component_id"].agg(set).to_dict() == {1: {1}, 2: {1}, 3: {1}, 9: {1}}
    assert got.groupby("doc_id")["kept"].all().to_dict() == {1: True, 2: False, 3: False, 9: False}


def test_circulant_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sig = minhash.signatures(np.concatenate([np.sort(both[:2000]), np.sort(both[1000:])]), np.array([0, 2000, 4000]), 512)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.07


# --- exact substrings --------------------------------------------------------------------------


def brute_repeats(texts, n):
    raws, starts = [(t or "").encode() for t in texts], Counter()
    for r in raws:
        starts.update(r[i : i + n] for i in range(len(r) - n + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - n + 1):
            if starts[r[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def brute_later(texts, n):
    """Removed bytes and runs of each text if each string stays where it stands first."""
    raws, seen, out = [(t or "").encode() for t in texts], {}, []
    for i, r in enumerate(raws):
        gone = bytearray(len(r))
        for k in range(len(r) - n + 1):
            if seen.setdefault(r[k : k + n], (i, k)) != (i, k):
                gone[k : k + n] = b"\1" * n
        out.append((sum(gone), len(re.findall(b"\1+", bytes(gone)))))
    return out


@pytest.mark.parametrize("most", [2048, 2])
def test_suffix_dedup_keeps_the_first(documents, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 3000)
    rng = random.Random(19)
    passage, other = prose(rng, 60), prose(rng, 130)
    texts = [None, "", "a" * 900, "ab" * 500] + [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(9)]
    texts += [edited(rng, other, 1) for _ in range(7)] + [other, f"{other} {prose(rng, 5)} {other}", texts[5][:400], prose(rng, 900)]
    rng.shuffle(texts)
    got = {r["key"]: suffix_dedup.merge([(x["start"], x["end"]) for x in r["spans"]]) for r in suffix_dedup.remove_repeats(documents(texts), 250, 32, most, keep_first=True).collect()}
    assert [(sum(e - s for s, e in got.get(i, [])), len(got.get(i, []))) for i in range(len(texts))] == brute_later(texts, 250)


@pytest.mark.parametrize("most", [2048, 2])
def test_suffix_dedup(documents, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 3000)
    rng = random.Random(9)
    passage, other = prose(rng, 90), prose(rng, 130)
    texts = [None, "", "short", "a" * 1500, "ab" * 700, "a" * 400, "a" * 399]
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(4)]
    texts += [prose(rng, 200) for _ in range(3)] + [other[i:] for i in (0, 3, 50)] + [edited(rng, other, 1) for _ in range(6)]
    texts += [other, other, f"{other} {prose(rng, 5)} {other}", prose(rng, 6000), texts[7][:600], "é" * 900]
    want = brute_repeats(texts, 400)
    rows = suffix_dedup.remove_repeats(documents(texts), sorted_most=most)
    if most == 2:
        assert {tuple(r) for r in rows.select("key", "th").collect()} == {tuple(r) for r in suffix_dedup.remove_repeats(documents(texts)).select("key", "th").collect()}
        spans = {r["key"]: suffix_dedup.merge([(x["start"], x["end"]) for x in r["spans"]]) for r in rows.collect()}
        assert {i: (sum(e - s for s, e in spans.get(i, [])), len(spans.get(i, []))) for i in range(len(texts))} == {i: w[1:3] for i, w in enumerate(want)}
        return
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(documents(texts)).toPandas().itertuples()}
    for i, w in enumerate(want):
        assert got[i] == w, (i, got[i], w)


def test_suffix_dedup_odd_rows(documents):
    assert suffix_dedup.digest(documents([])).count() == 0
    t = prose(random.Random(1), 150)
    got = suffix_dedup.digest(documents([t, t, t[::-1], None], [None, 3, 3, 5])).toPandas()
    assert sorted(got["n_removed"].tolist()) == [0, 0, len(t.encode()), len(t.encode())]
    left = suffix_dedup.strip(documents([t, t, None, "é" * 500]))
    assert left.columns == documents([]).columns
    assert {r["doc_id"]: r["text"] for r in left.collect()} == {0: "", 1: "", 2: None, 3: ""}


def test_suffix_order():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    starts, raw = rng.integers(0, 590, 500), data.tobytes()
    ends = np.minimum(600, starts + rng.integers(0, 60, 500))
    suffixes = suffix_dedup.Suffixes(data)
    for segment in (np.zeros(500, int), np.arange(500) // 7):
        order = suffixes.sort(starts, ends, segment)
        key = lambda i, s=segment: (s[i], raw[starts[i] : ends[i]])
        assert [key(i) for i in order.tolist()] == sorted(map(key, range(500)))


def test_repeated_windows_of_a_group():
    rng = random.Random(8)
    for _ in range(60):
        length = rng.choice([6, 9])
        contexts, first, last, group = [], [], [], []
        for _ in range(rng.randrange(2, 30)):
            hi = rng.randrange(0, length - 2)
            lo = rng.randrange(0, hi + 1)
            contexts.append("".join(rng.choice("ab") for _ in range(hi)).encode() + b"x" + "".join(rng.choice("ab") for _ in range(length - lo - 1)).encode())
            first.append(hi)
            last.append(lo)
            group.append(rng.randrange(2))
        seen = Counter()
        for c, hi, lo, g in zip(contexts, first, last, group, strict=True):
            seen.update((g, a, c[hi - a : hi - a + length]) for a in range(lo, hi + 1))
        want = {(i, a) for i, (c, hi, lo, g) in enumerate(zip(contexts, first, last, group, strict=True)) for a in range(lo, hi + 1) if seen[g, a, c[hi - a : hi - a + length]] > 1}
        got = suffix_dedup.repeated_windows(contexts, np.array(group), np.array(first), np.array(last), length)
        assert {(int(i), a) for i, low, high in zip(*got, strict=True) for a in range(low, high + 1)} == want


# --- fingerprints ------------------------------------------------------------------------------


def test_prefix_hash_and_extensions():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    prefix, raw = fingerprints.PrefixHash(data), data.tobytes()
    a, b = rng.integers(0, 350, 300), rng.integers(0, 350, 300)
    most = np.full(300, 50)
    want = [next((k for k in range(50) if raw[i + k] != raw[j + k]), 50) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert prefix.common_extension(a, b, most).tolist() == want
    spans = {}
    for s, e in itertools.combinations(range(0, 60), 2):
        spans.setdefault(int(prefix.spans(np.array([s]), np.array([e]))[0]), set()).add(raw[s:e])
    assert all(len(x) == 1 for x in spans.values())


def test_fingerprints(documents):
    rng = random.Random(2)
    texts = [None, "", "a", "ab", "abc", "žluť" * 9, prose(rng, 300), prose(rng, 40), prose(rng, 40), prose(rng, 9000)]
    texts.append(texts[6])
    ids = [50 + 3 * i for i in range(len(texts))]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(documents(texts, ids)).collect()}
    assert len(got) == len(texts)
    for k, i in enumerate(ids):
        t, nxt = texts[k] or "", texts[k - 1] or ""
        n = len(t) // 3
        e = t[: len(t) - n] + nxt[:n]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        assert got[i]["common_prefix"] >= len(t) - n
        assert (got[i]["near_edited"] == 1) == (e == t)
    assert got[ids[6]]["fingerprint"] == got[ids[10]]["fingerprint"]
    assert len({r["fingerprint"] for r in got.values()}) == len(set(t or "" for t in texts))
    assert 0.3 < got[ids[6]]["near_edited"] < 0.7 and got[ids[8]]["near_next"] < 0.1


def test_fingerprints_odd_rows(documents):
    assert fingerprints.fingerprint_edits(documents([])).count() == 0
    got = fingerprints.fingerprint_edits(documents(["abcdef"])).collect()
    assert got[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    assert fingerprints.fingerprint_edits(documents(["abc", "abc", "xyz", None], [None, 5, 5, None])).count() == 4


def test_fingerprints_of_an_id_that_many_rows_share(documents):
    rng = random.Random(16)
    texts = [prose(rng, rng.randrange(1, 30)) for _ in range(120)]
    ids = [None] * 50 + [7] * 40 + list(range(30))
    docs = documents(texts, ids)
    keys, hot = fingerprints._ranges(docs.select(F.coalesce("doc_id", F.lit(fingerprints.LEAST_KEY)).alias("key")), 16)
    assert set(hot) == {fingerprints.LEAST_KEY, 7} and all(len(h) for h in hot.values()) and 8 in keys
    hashes = dict(zip(texts, [r[0] for r in docs.select(F.xxhash64("text")).collect()], strict=True))
    order = sorted(zip(ids, texts, strict=True), key=lambda x: (-math.inf if x[0] is None else x[0], hashes[x[1]]), reverse=True)
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        want.append((i, hashlib.sha256(fingerprints.edit(t, nxt).encode()).hexdigest()))
    got = fingerprints.fingerprint_edits(docs).select("doc_id", "edited_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(want)


# --- personal data -----------------------------------------------------------------------------

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text):
            digits = [int(c) for c in m.group() if "0" <= c <= "9"]
            luhn = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], list(FORMS).index(x[0])))


def test_pii_base_forms(documents):
    rng = random.Random(4)
    bits = ["a.b@c.de", "x@y", "@", "a@b@c.d", "a@@b.c", "u%+-@-.-", "1.2.3.4", "256.1.1.1", "001.02.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+4.", "١٢", " ", "-", "tél ", "x" * 40, "+", "9", ".", "a@b.c.", "\n"]
    texts = [None, "", "z" * 60_000] + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    got = {r["doc_id"]: r for r in pii.digest(documents(texts)).collect()}
    for i, t in enumerate(texts):
        want = brute_pii(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(pii.joined(want).encode()).hexdigest(), (t, want)
        assert [got[i][f"n_{k}"] for k in FORMS] == [sum(w[0] == k for w in want) for k in FORMS]
        assert set(pii.joined(want).split(",")) <= set(got[i]["spans"].split(","))


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write to jane [at] site [dot] org now", "email", "jane [at] site [dot] org"),
        ("write to jane at site dot org now", "email", "jane at site dot org"),
        ("mail jаne@site.org now", "email", "jаne@site.org"),
        ("call plus one five five five one two three four five six seven now", "phone", "plus one five five five one two three four five six seven"),
        ("host １９２.168.0.1 up", "ip", "１９２.168.0.1"),
        ("host 192[.]168[.]1[.]10 up", "ip", "192[.]168[.]1[.]10"),
        ("host one nine two dot 168 dot one dot one zero up", "ip", "one nine two dot 168 dot one dot one zero"),
        ("mail john @ site.org now", "email", "john @ site.org"),
        ("mail john&#64;site&#46;org now", "email", "john&#64;site&#46;org"),
    ],
)
def test_pii_disguises(text, kind, found):
    s = text.index(found)
    assert pii.all_spans(text) == ([], [(kind, s, s + len(found))]) or (kind, s, s + len(found)) in pii.all_spans(text)[1]


@pytest.mark.parametrize("found", [
    "jane [at] corp [dot] example", "jane at corp dot example", "jane (at) studio (dot) photography", "jane at studio dot photography", "jane [at] site [dot] xn--p1ai", "jane @ mail . company . photography",
    "jane [at] host [dot] a1", "jane at corp [dot] xn--p1ai", "jane @ site.photography", "jane@studio [dot] photography", "jane at x dot " + "a" * 63,
])
def test_pii_disguises_with_any_last_label(found):
    text = f"write to {found}, please"
    s = text.index(found)
    assert ("email", s, s + len(found)) in pii.all_spans(text)[1]
    assert pii.mask(text, pii.all_spans(text)[1]) == "write to <email>, please"


@pytest.mark.parametrize(("text", "masked"), [("3 items @ 5.99 each", None), ("3 items @ 5.99 . Yesterday", None), ("mail jane@site.org . Yesterday [at] noon", "mail <email> . Yesterday [at] noon")])
def test_pii_last_label_is_no_price_or_sentence(text, masked):
    assert pii.mask(text, pii.all_spans(text)[1]) == (masked or text)


@pytest.mark.parametrize("text", [
    "z" * 100_000 + " a [at] b [dot] c " + "z" * 100_000, "1" * 200_000, "1" * 200_000 + " a [at] b [dot] c", "a." * 100_000 + " x [at] y", " " * 200_000 + "[at] x dot y", "a [at] " + "b." * 100_000, "one " * 50_000 + "x dot y",
    "a at b dot cc " * 15_000, "( " * 100_000 + " dot ", "1." * 100_000 + "one two [dot] ", "a@b.c " * 33_000 + "x [at] y [dot] z", "+1 " * 66_000 + " dot ", "a" + " " * 100_000 + "at" + " " * 99_000 + "b dot cc", "%" * 100_000 + "%40" * 33_000,
], ids=range(14))
def test_pii_takes_linear_time(text):
    took = []
    for part in (text[: len(text) // 2], text):
        start = time.process_time()
        base, every = pii.all_spans(part)
        pii.mask(part, every)
        took.append(time.process_time() - start)
    assert took[1] < 2 and set(base) <= set(every)


def test_pii_leaves_plain_text_alone(documents):
    for text in ("We met at noon and saw the dot on the map.", "one two three four five six", "version 1.2.3 of 2024-01-02", "look at this dot", "See you @ home. Then we go.", "1 dot 2 dot 3", "a rise of 40%40 years"):
        assert pii.all_spans(text) == ([], [])
    got = pii.find_pii(documents(["a a.b@c.de b", None]))
    assert [c for c in got.columns if c not in documents([]).columns] == ["base_spans", "masked"]
    assert [r["masked"] for r in got.orderBy("doc_id").collect()] == ["a <email> b", None]
    assert pii.digest(documents([])).count() == 0


# --- packing -----------------------------------------------------------------------------------


def test_packing(documents):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    texts = [None, "", "Ünïcode it's 12 <|endoftext|> İstanbul é ĳ", prose(rng, 9000), "x" * 20_000] + [prose(rng, rng.randrange(1, 900)) for _ in range(60)]
    texts[7] = texts[6]
    path = tokenizer_file("word_bpe_49k.json")
    got = packing.pack(documents(texts), path).toPandas()
    tokenizer = Tokenizer.from_file(path)
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]
    for i, own in got.groupby("doc_id"):
        own = own.sort_values("start")
        assert own["start"].tolist() == [0, *np.cumsum(own["length"])[:-1].tolist()]
        assert own["length"].sum() == len(ids[i]) and set(own["doc_tokens"]) == {len(ids[i])}
        assert [zlib.crc32(ids[i][s : s + n].tobytes()) for s, n in zip(own["start"], own["length"], strict=True)] == own["ids_crc32"].tolist()
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1].tolist()] and own["length"].sum() <= 4096
    assert got["sequence_id"].nunique() <= 11 / 9 * math.ceil(got["length"].sum() / 4096) + 1
    # repeated rows don't stay together
    many = packing.pack(documents([None] * 400, [None] * 400), path, group_pieces=40).toPandas()
    assert len(many) == 400 and (many["sequence_id"] // (1 << 40)).nunique() >= 8
    # a null beside an id that a double can't hold
    large = packing.pack(documents(["a", "b"], [None, (1 << 60) + 1]), path).collect()
    assert {r["doc_id"] for r in large} == {None, (1 << 60) + 1}
    assert packing.pack(documents([]), path).count() == 0


def test_first_fit_decreasing():
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 101, 300)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room, at = [], {}
    for i in np.argsort(-sizes, kind="stable").tolist():
        b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(100)
        at[i] = (b, 100 - room[b])
        room[b] -= sizes[i]
    assert [(int(b), int(o)) for b, o in zip(bins, offsets, strict=True)] == [at[i] for i in range(300)]


# --- sentencepiece -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(tokenizer_file("piece_bpe_32k.model"))


def test_sentencepiece_viterbi(vocabulary):
    rng = random.Random(7)
    table = {vocabulary.pieces[i]: i for i in vocabulary.ids.tolist()}
    words = [" " + "".join(rng.choice("abcdeénst漢") for _ in range(rng.randrange(1, 9))) for _ in range(200)] + [" ", "   ", " the", "\n", "▁", " 𝄞x"]
    for w, ids in zip(words, vocabulary.encode_words(words), strict=True):
        best = [0.0] + [-math.inf] * len(w)
        own = w.replace("▁", "\U0010ffff").replace(" ", "▁")
        for j in range(1, len(w) + 1):
            for i in range(max(0, j - vocabulary.longest), j):
                piece = own[i:j]
                gain = vocabulary.scores[table[piece]] if piece in table else len(w[i:j].encode()) * (vocabulary.floor - pieces.BYTE_COST) if j - i == 1 else -math.inf
                best[j] = max(best[j], best[i] + gain)
        byte_ids = set(vocabulary.bytes.tolist())
        score = sum(vocabulary.floor - pieces.BYTE_COST if i in byte_ids else vocabulary.scores[i] for i in ids.tolist())
        assert abs(score - best[-1]) < 1e-6, w


def test_sentencepiece_round_trip(documents, vocabulary):
    rng = random.Random(3)
    texts = [None, "", " ", "\n", "  two  blanks \n\n and\ttabs ", "▁ mark ▁▁", "漢字 𝄞 é́ \u0000", prose(rng, 5000), "q" * 3000, "same", "same"]
    texts += ["".join(chr(rng.choice([32, 10, 97, 98, 0x2581, 0xE9, 0x1F600, 9])) for _ in range(40)) for _ in range(50)]
    got = pieces.encode_decode(documents(texts), tokenizer_file("piece_bpe_32k.model")).collect()
    for r in got:
        t = texts[r["doc_id"]] or ""
        assert r["round_trip"] and vocabulary.decode(np.array(r["ids"], int)) == t and r["n_chars"] == len(t) and r["n_tokens"] == len(r["ids"])
    assert pieces.encode_decode(documents([]), tokenizer_file("piece_bpe_32k.model")).count() == 0


# --- language model ----------------------------------------------------------------------------


def test_language_model(documents):
    rng = random.Random(11)
    texts = [None, "", "  ", "New unseen wörds 漢 here", "the the THE", prose(rng, 3000)] + [prose(rng, rng.randrange(1, 80)) for _ in range(40)]
    texts += [texts[8]]
    train = [i % 3 != 2 for i in range(len(texts))]
    path = tokenizer_file("piece_bpe_32k.model")
    docs = documents(texts)
    got = {r["doc_id"]: r for r in language_model.score(docs, F.col("doc_id") % 3 != 2, path, head=50).collect()}
    tokens = [[*WORD.findall((t or "").translate(LOWER)), None] for t in texts]
    c = Counter(w for ts, k in zip(tokens, train, strict=True) if k for w in ts)
    n, v = sum(c.values()), len(c)
    vocabulary = pieces.Vocabulary(path)
    counts = docs.sparkSession.createDataFrame([(w, k) for w, k in c.items() if w is not None], "word string, n long")
    logs = language_model.learn(counts, c[None], path)
    table = {vocabulary.pieces[i]: logs[i] for i in vocabulary.ids.tolist()}

    def marginal(word):
        own = "▁" + word
        total = [1.0] + [0.0] * len(own)
        for j in range(1, len(own) + 1):
            for i in range(j):
                p = table.get(own[i:j], len(own[i:j].encode()) * logs[vocabulary.bytes[0]] if j - i == 1 else -math.inf)
                total[j] += total[i] * math.exp(p)
        return math.log10(total[-1])

    for i, ts in enumerate(tokens):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not train[i], len(ts), sum(c[w] > 0 for w in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ts))
        assert r["score"] == pytest.approx(sum(marginal(w) for w in ts if w is not None) + logs[vocabulary.end] / math.log(10))


def test_language_model_odd_rows(documents):
    path = tokenizer_file("piece_bpe_32k.model")
    assert language_model.score(documents([]), F.lit(True), path).count() == 0
    none = language_model.score(documents(["a b", None]), F.lit(False), path).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and r["score"] < 0 for r in none)
    twice = language_model.score(documents(["new words", "new words", "new", "zz qq"], [1, 1, 1, None]), F.col("doc_id").isNull(), path).toPandas()
    assert len(twice) == 4 and sorted(twice["n_tokens"]) == [2, 3, 3, 3] and twice[twice["n_tokens"] == 3]["score"].nunique() == 2


def test_learning_raises_likelihood(documents):
    rng = random.Random(1)
    docs = documents([prose(rng, 200) for _ in range(10)])
    path = tokenizer_file("piece_bpe_32k.model")
    before = language_model.score(docs, F.lit(False), path).agg(F.sum("score")).first()[0]
    assert language_model.score(docs, F.lit(True), path).agg(F.sum("score")).first()[0] > before


# --- language id -------------------------------------------------------------------------------

SAMPLES = {
    "en": "the quick brown fox jumps over the lazy dog and then it runs with all of the others through this forest where they live",
    "de": "der schnelle braune fuchs springt über den faulen hund und läuft dann mit allen anderen durch diesen wald in dem sie leben",
    "ru": "быстрая коричневая лиса прыгает через ленивую собаку и потом бежит вместе со всеми другими через этот лес где они живут",
}


def labelled(spark, rng, n):
    rows = []
    for i in range(n):
        k = list(SAMPLES)[i % 3]
        w = SAMPLES[k].split()
        rows.append((" ".join(rng.choice(w) for _ in range(30)), k, i))
    return rows


def test_language_id(spark, documents):
    rng = random.Random(12)
    model = language_id.fit(spark.createDataFrame([*labelled(spark, rng, 90), (None, "en", 1), ("x", None, 2)], "text string, lang string, pick long"))
    assert model.languages == ["de", "en", "ru"]
    texts = [None, "", "123 !?", " ".join(SAMPLES["en"].split()[:12]) + ". " + " ".join(SAMPLES["de"].split()[:5]), SAMPLES["ru"], SAMPLES["de"] * 900, "лес", "漢字"]
    got = {r["doc_id"]: r for r in language_id.identify(documents(texts), model).collect()}
    assert [got[i]["lang_pred"] for i in range(7)] == ["und", "und", "und", "en", "ru", "de", "ru"] and got[7]["lang_pred"] in model.languages
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[4]["score"] == 1
    assert [(s["lang"], texts[3][s["start"] : s["end"]]) for s in got[3]["spans"]] == [("en", " ".join(SAMPLES["en"].split()[:12])), ("de", " ".join(SAMPLES["de"].split()[:5]))]
    held = labelled(spark, rng, 60)
    found = language_id.identify(documents([h[0] for h in held]), model).orderBy("doc_id").collect()
    assert sum(r["lang_pred"] == h[1] for r, h in zip(found, held, strict=True)) == 60
    assert language_id.identify(documents([]), model).count() == 0


def test_language_id_without_labels(spark, documents):
    model = language_id.fit(spark.createDataFrame([], "text string, lang string, pick long"))
    assert [r["lang_pred"] for r in language_id.identify(documents(["abc", None]), model).collect()] == ["und", "und"]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(4)
    counts = np.array([4, 0, 1, 6, 3])
    scores = rng.normal(0, 3, (counts.sum(), 3))
    path, at = language_id.viterbi(scores, counts, 2.0), 0
    for n in counts.tolist():
        own = scores[at : at + n]
        value = lambda p, own=own: sum(own[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p[:-1], p[1:], strict=True))
        assert value(path[at : at + n].tolist()) == pytest.approx(max(map(value, itertools.product(range(3), repeat=n))))
        at += n


# --- neighbours --------------------------------------------------------------------------------


def exact_neighbours(ids, x, queries, k):
    out = {}
    for q in queries:
        s = [(-float(np.dot(x[i], x[q])), ids[i], i) for i in range(len(ids)) if ids[i] != ids[q]]
        out[ids[q]] = [(v, -sc) for sc, v, _ in sorted(s)[:k]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(700, 12)) * rng.uniform(0.5, 2, (700, 1)), np.tile(rng.normal(size=(1, 12)), (300, 1))])
    ids = list(range(1000))
    bad = [(2000, None), (2020, [0.0] * 12), (2040, [float("nan")] * 12), (2060, [None] * 12), (None, [1.0] * 12), (2080, [1.0] * 5), (2100, [float("inf")] * 12)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + bad + [(3, x[3].tolist())], "vec_id long, embedding array<double>")
    got = neighbours.nearest(rows, F.col("vec_id") % 20 == 0, sample_rows=800).toPandas()
    want = exact_neighbours(ids, x, range(0, 1000, 20), 20)
    hits = 0
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, len(own) + 1)) and q not in own["vec_id"].tolist()
        assert np.allclose(own["score"], [x[q] @ x[v] for v in own["vec_id"]], rtol=1e-12)
        assert list(zip(-own["score"], own["vec_id"], strict=True)) == sorted(zip(-own["score"], own["vec_id"], strict=True))
        hits += len(set(own["vec_id"]) & {v for v, _ in want[q]})
    assert set(got["query_id"]) == set(want) and hits / (20 * len(want)) >= 0.9


@pytest.mark.parametrize("clusters", [0, 300])
def test_neighbours_at_production_settings(spark, clusters):
    rng = np.random.default_rng(23)
    x = rng.normal(size=(20_000, 32))
    if clusters:
        x = 4 * rng.normal(size=(clusters, 32))[rng.integers(0, clusters, len(x))] + x
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    got = neighbours.nearest(rows, F.col("vec_id") % 20 == 0).toPandas()
    queries = np.arange(0, len(x), 20)
    score = x[queries] @ x.T
    score[np.arange(len(queries)), queries] = -np.inf
    want = np.argpartition(-score, 20)[:, :20]
    found = got.groupby("query_id")["vec_id"].agg(set)
    assert len(got) == 20 * len(queries)
    assert sum(len(found[q] & set(w.tolist())) for q, w in zip(queries.tolist(), want, strict=True)) / want.size >= 0.9


def test_neighbours_of_a_repeated_id(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (3, [1.0, 0.5]), (3, [0.5, 0.25])], "vec_id long, embedding array<double>")
    got = neighbours.nearest(rows, F.col("vec_id") % 20 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 3, 1.0)]


def test_neighbours_of_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert neighbours.nearest(spark.createDataFrame([], kind), F.col("vec_id") % 20 == 0).count() == 0
    got = neighbours.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [1.0, 0.0])], kind), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 3), (0, 2, 7)]


# --- paragraphs --------------------------------------------------------------------------------


def brute_units(texts):
    """Units of each text by the docstring of ``paragraphs``: (doc, start, end) in bytes, and their texts."""
    rows = []
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        spans = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        data, offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
        starts, _, row, hashes = paragraphs.word_hashes(data, offsets) if spans else ([], [], [], [])
        found = []
        at = 0
        for line in raw.split(b"\n"):
            own = [k for k, (s, _) in enumerate(spans) if at <= s < at + len(line) + 1]
            if len(own) >= 20:
                found.append((True, spans[own[0]][0], spans[own[-1]][1], tuple(raw[spans[k][0] : spans[k][1]].lower() for k in own)))
            at += len(line) + 1
        if spans:
            for w in paragraphs.anchors(hashes, row, 1)[0].tolist():
                found.append((False, spans[w][0], spans[w + 23][1], tuple(raw[s:e].lower() for s, e in spans[w : w + 5])))
        rows.append(found)
    seen = Counter((u[0], u[3]) for found in rows for u in found)
    out = {}
    for i, found in enumerate(rows):
        lines = [(s, e) for line, s, e, m in found if line and seen[True, m] > 1]
        for line, s, e, m in found:
            if line or (seen[False, m] > 1 and not any(s < b and a < e for a, b in lines)):
                out[i, s, e] = (texts[i].encode())[s:e].decode()
    return out


def test_paragraphs(documents):
    rng = random.Random(13)
    passage, inner = prose(rng, 60), prose(rng, 51)
    texts = [f"{prose(rng, 30)}\n{passage}\n{prose(rng, 25)}", f"{edited(rng, passage, 1)}\nfew words", None, "", f"few words\n{passage}\n{passage}", prose(rng, 20_000)]
    texts += [f"{prose(rng, 40)} {inner} {prose(rng, 30)}" for _ in range(2)] + [f"{prose(rng, 9)} {inner[:90]}\n{inner[90:]} {prose(rng, 33)}"]
    texts += ["\n".join([prose(rng, 22), "one two three four five six seven", prose(rng, 19)]) for _ in range(3)]
    units = brute_units(texts)
    want = brute_components(list(range(len(units))), list(units.values()))
    names = list(units)
    members = {}
    for k, (_, c) in want.items():
        members.setdefault(c, []).append(names[k])
    real = {c: m for c, m in members.items() if len({x[0] for x in m}) > 1 or max(x[1] for x in m) >= min(x[2] for x in m)}
    expected = {m: min(own)[:2] for own in real.values() for m in own}
    rows = paragraphs.repeated_paragraphs(documents(texts)).collect()
    assert {(r["doc_id"], r["start"], r["end"]): (r["component_doc"], r["component_start"]) for r in rows} == expected
    assert {r["doc_id"] for r in rows} == {0, 1, 4, 6, 7, 8} and sum(r["kept"] for r in rows) == len(real)
    left = {r["doc_id"]: r["text"] for r in paragraphs.remove(documents(texts)).collect()}
    assert left[0] == texts[0] and left[1] == "\nfew words" and left[2] is None and left[4] == "few words\n\n" and left[5] == texts[5]
    assert left[6] == texts[6] and len(left[7]) < len(texts[7]) - 80 and inner not in left[7]
    assert paragraphs.repeated_paragraphs(documents([])).count() == 0


def test_every_run_of_51_words_holds_a_window(documents):
    rng = random.Random(14)
    for _ in range(300):
        inner = prose(rng, 51, 60)
        found = []
        for _ in range(2):
            before = prose(rng, rng.randrange(0, 60), 60)
            raw = f"{before} {inner} {prose(rng, rng.randrange(0, 60), 60)}".encode()
            _, _, row, hashes = paragraphs.word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            n = len(before.split())
            found.append({w - n for w in paragraphs.anchors(hashes, row, 1)[0].tolist() if n <= w <= n + 51 - 24})
        assert found[0] & found[1]


def test_paragraphs_of_repeated_ids(documents):
    rng = random.Random(15)
    a, b = prose(rng, 40), prose(rng, 40)
    rows = paragraphs.repeated_paragraphs(documents([a, a, b, a, None], [1, 1, 1, -(1 << 62), None])).collect()
    assert sorted((r["doc_id"], r["start"], r["kept"]) for r in rows) == [(-(1 << 62), 0, True), (1, 0, False)]
