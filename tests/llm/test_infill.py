"""Fill-in-middle transformation against a plain version, on texts of every kind."""

import hashlib
import re

import pytest
from posegrid.llm import infill

MARKS = ("<P>", "<S>", "<M>")


def plain_version(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


TEXTS = [
    None, "", "\n", "\n\n\n", "one line", "one line\n", "a\nb\nc\nd", "a\nb\nc\nd\n", "é\n😀😀\n same line\r\nnext", "holds <M>\nso it stays", "<P", "<\nP>\nS>\n<", "tabs\tand \x00 zero\nbytes\x00\n", "é\n" * 5000, "x" * 1_200_000, "y\n" * 300_000, *[f"row {i}\n" * (i % 13) + "end" for i in range(40)],
]


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 0), (70, 100)])
def test_forms_and_outputs(documents, rate, spm):
    ids = [*range(len(TEXTS))]
    got = {r.doc_id: tuple(r)[1:] for r in infill.fill_in_middle(documents(TEXTS, ids), rate=rate, spm=spm).collect()}
    assert got == {i: plain_version(i, t, rate, spm) for i, t in zip(ids, TEXTS, strict=True)}
    if rate == 100:
        assert {form for _, form, *_ in got.values()} == {"plain", "psm", "spm"}


def test_digest_null_and_repeated_ids(documents):
    ids, texts = [None, None, 5, 5, 2**62, -3], ["a\nb\nc", "a\nb\nc", "same\ntext\n", "same\ntext\n", "x\ny\n", "x\ny\n"]
    rows = infill.digest(documents(texts, ids)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = [(i, *v[:4], sha(v[4]), sha(v[5])) for i, t in zip(ids, texts, strict=True) for v in [plain_version(i, t)]]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, rows), key=key) == sorted(expected, key=key)


def test_empty_table(documents):
    empty = documents(["x"]).filter("doc_id < 0")
    assert infill.fill_in_middle(empty).collect() == []
    assert infill.digest(empty).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
