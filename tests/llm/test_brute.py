"""Pseudonyms and licences against slow, plain versions; registered queries against their operators' parts."""

from __future__ import annotations

import hashlib
import os
import re
import sys
import zlib
from datetime import date

import numpy as np

from gleanset.llm import license_scan, pii, pretokens, queries

sys.path.insert(0, os.path.dirname(__file__))
from test_llm import ODD, linked_by_hand, print_by_hand, table

SF = "/root/testdata/sf0.001"


# --- pseudonyms: the same Feistel network and validation, step by step ------------------------------


def rand(key, *on):
    return int(hashlib.sha256("|".join([key, *map(str, on)]).encode()).hexdigest()[:15], 16)


def feistel(key, kind, left, right, left_size, right_size):
    for i in range(pii.ROUNDS):
        left, right = right, (left + rand(key, kind, i, right)) % (left_size if i % 2 == 0 else right_size)
    return left, right


def permuted(key, kind, digits):
    n, half = len(digits), len(digits) // 2
    if n < 2:
        return digits
    a, b = feistel(key, f"{kind}/{n}", int(digits[:half]), int(digits[half:]), 10**half, 10 ** (n - half))
    return f"{a:0{half}d}{b:0{n - half}d}"


def refilled(layout, digits):
    digits = iter(digits)
    return "".join(next(digits) if c.isdigit() else c for c in layout)


def digits_of(text):
    return re.sub("[^0-9]", "", text)


def luhn(payload):
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def email(key, m):
    return f"user-{rand(key, 'email', m.lower()):015x}@example.invalid"


def ipv4(key, m):
    o = [int(x) for x in m.split(".")]
    if max(o) > 255:
        return None
    a, b = feistel(key, "ipv4", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def card(key, m):
    d = digits_of(m)
    if luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    payload = d[0] + permuted(key, "card", d[1:-1])
    return refilled(m, payload + str(luhn(payload)))


def phone(key, m):
    d = digits_of(m)
    if not 7 <= len(d) <= 15:
        return None
    coded = re.match(r"\+?([0-9]{1,3})[ .(-]", m)
    code = 1 if re.match(r"\+?1", m) and len(d) == 11 else (len(coded[1]) if coded else 2) if m[0] == "+" else 0
    return refilled(m, d[:code] + permuted(key, "phone", d[code:]))


def ssn(key, m):
    valid = re.compile("(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}").fullmatch
    d = digits_of(m)
    if not valid(d):
        return None
    d = permuted(key, "ssn", d)
    while not valid(d):
        d = permuted(key, "ssn", d)
    return refilled(m, d)


def iban(key, m):
    c = m.replace(" ", "")
    if mod97(c[4:] + c[:4]) != 1:
        return None
    account = refilled(c[4:], permuted(key, "iban", digits_of(c[4:])))
    new = iter(f"{c[:2]}{98 - mod97(account + c[:2] + '00'):02d}{account}")
    return "".join(x if x == " " else next(new) for x in m)


def day_of(y, m, d):
    """Days from 0001-01-01 as 1; a year 0 is a leap year before it."""
    try:
        return date(y, m, d).toordinal() if y else date(4, m, d).toordinal() - date(4, 1, 1).toordinal() - 365
    except ValueError:
        return None


def from_day(n):
    if n >= 1:
        return tuple(date.fromordinal(n).timetuple()[:3])
    return (0, *date.fromordinal(n + 365 + date(4, 1, 1).toordinal()).timetuple()[1:3])


def dated(key, m):
    a, b, c = map(int, re.split("[./-]", m.rstrip(".")))
    year_first = bool(re.match("[0-9]{4}", m))
    first = day_of(a, b, c) if year_first else day_of(c, b, a)
    day = first if year_first or first is not None else day_of(c, a, b)
    if day is None:
        return None
    start = date.fromisoformat(pii.FIRST_DAY).toordinal()
    n = day - start
    near = 0 <= n < pii.NEAR
    if near:
        size, kind, x = (pii.HALF_DAYS, pii.HALF_DAYS), "date", n
    else:
        size, kind = (pii.FAR_LEFT, pii.FAR_RIGHT), "date/far"
        x = n + pii.BEFORE - (0 if n < 0 else pii.NEAR)
    while True:
        left, right = feistel(key, kind, x // size[1], x % size[1], *size)
        x = left * size[1] + right
        if near or x < pii.FAR:
            break
    n = x if near else x - pii.BEFORE + (0 if x < pii.BEFORE else pii.NEAR)
    y, mo, d = from_day(n + start)
    padded = re.fullmatch(r"(?:[0-9]{4}.)?[0-9]{2}.[0-9]{2}(?:.[0-9]{4})?", m)
    mo, d = (f"{mo:02d}", f"{d:02d}") if padded else (str(mo), str(d))
    middle = [mo, d] if year_first or first is None else [d, mo]
    mark = re.search("[./-]", m)[0]
    return mark.join([f"{y:04d}", *middle] if year_first else [*middle, f"{y:04d}"])


MAKE = {"email": email, "iban": iban, "ssn": ssn, "date": dated, "ipv4": ipv4, "phone": phone, "card": card}


def by_hand(key, text):
    out, found, at = "", [], 0
    for match in re.finditer(pii.CANDIDATE, text or "", re.A):
        for kind, shape, _ in pii.KINDS:
            if re.fullmatch(shape, match[0], re.A) and (new := MAKE[kind](key, match[0])) is not None:
                found.append((kind, match.start(), len(match[0]), new))
                out += text[at : match.start()] + new
                at = match.end()
                break
    return (out + text[at:]) if text is not None else None, found


CHOSEN = [
    *ODD,
    "4111 1111 1111 1111, 4111-1111-1111-1111, 378282246310005, 3782 822463 10005 and 0000000000000000",
    "+1 (017) 555-7713 is (017) 555-7713, 017.555.7713, +49 30 901820, +44 20 7946 0958 and +12 1",
    "169.122.221.182, 256.1.1.1, 1.2.3.4.5, DE89 3704 0044 0532 0130 00, GB29NWBK60161331926819, DE00 3704 0044 0532 0130 00",
    "1980-02-29 29.02.1980 2/29/1980 29/2/1980 31.4.1999 0000-02-29 9999-12-31 1899/01/05 2024-05-01T10:00 5-6-2031",
    "a.b@c.example.org. THE.72@MAIL3.EXAMPLE.COM!! x@y z@w.c not@a.b1 q@x-y.co.uk",
    "078-05-1120 000-12-3456 666-12-3456 123-00-4567 899-99-9999",
    "naïve é 4111111111111111 👩‍👩‍👧 1990-01-01 日本",
]


def test_pseudonyms_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + list(enumerate(CHOSEN, 10**6))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen = set()
    for r in pii.pseudonymise(df, "some key").collect():
        text, found = by_hand("some key", dict(rows)[r.doc_id])
        assert (r.text, [(f.kind, f.start, f.length, f.pseudonym) for f in r.found]) == (text, found)
        seen |= {f[0] for f in found}
    assert seen == set(MAKE)


def test_query_pseudonyms(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op2_pseudonyms(spark, SF).collect():
        text, found = by_hand(queries.PSEUDONYM_KEY, texts.pop(r.doc_id))
        assert (r.text, r.n_found) == (text, len(found))
    assert not texts


# --- licences: alignment from every word of the text ----------------------------------------------


def scan_by_hand(scanner, text):
    words, start, stop = license_scan.words_of(text.lower())
    found = set()
    for name, template in scanner.templates.items():
        for a in range(-len(template), len(words)):
            if (hit := scanner._found(name, words, max(a, 0), max(a, 0))) is not None:
                found.add((name, *hit))
    ranked = sorted(((n * n / (b - a + 1), n / len(scanner.templates[name]), name, a, b) for name, n, a, b in found), key=lambda f: (-f[0], -f[1], f[2], f[3]))
    out, taken = [], []
    for _, share, name, a, b in ranked:
        if all(b < x or a > y for x, y in taken):
            taken.append((a, b))
            out.append((name, start[a], stop[b], share))
    return sorted(out, key=lambda f: (f[1], f[0]))


def test_licences_against_alignment_from_every_word(spark):
    scanner = license_scan.Scanner(license_scan.TEMPLATES, 0.8)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text) < 900]
    names = license_scan.TEMPLATES
    texts += [f"Before. {t} After it." for t in names.values() if len(t) < 900]
    texts += ["Released under the MIT License. " * 4, "under the the License License of of Apache MIT", "all rights all rights reserved reserved", ""]
    hits = 0
    for text in texts:
        got = scanner.scan(text)
        assert got == scan_by_hand(scanner, text), text[:200]
        hits += len(got)
    assert hits > 20


def test_many_notices_in_one_text(spark, tmp_path):
    text = "Released under the MIT License. " * 30_000
    (row,) = license_scan.scan_licenses(table(spark, [text], tmp_path)).collect()
    assert len(row.licenses) == 30_000
    assert license_scan.scan_licenses(table(spark, ["x"], tmp_path, "y").filter("doc_id > 3")).collect() == []
    docs = table(spark, ["Released under the MIT License."] * 3, tmp_path, "z", ids=[5, 5, None])
    assert sorted(repr((r.doc_id, r.licenses[0].name)) for r in license_scan.scan_licenses(docs).collect()) == sorted(
        map(repr, [(5, "MIT"), (5, "MIT"), (None, "MIT")])
    )


# --- registered queries ---------------------------------------------------------------------------


def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_query_licences(spark):
    scanner, texts = license_scan.Scanner(license_scan.TEMPLATES, 0.8), documents(spark)
    for r in queries.op3_licenses(spark, SF).collect():
        want = scanner.scan(texts.pop(r.doc_id))
        assert [(h.name, h.start, h.end) for h in r.licenses] == [h[:3] for h in want] and r.n_licenses == len(want)
    assert not texts


def test_query_token_files(spark):
    library, texts, start = pretokens.load("byte_bpe_50k.json"), documents(spark), 0
    got = {r.doc_id: r for r in queries.op5_token_files(spark, SF).collect()}
    assert set(got) == set(texts)
    for i in sorted(texts):
        ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_query_packing(spark):
    library, texts = pretokens.load("word_bpe_49k.json"), documents(spark)
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    rows = queries.op6_packing(spark, SF).collect()
    pieces, windows = {}, {}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, tokens in ids.items():
        assert [s for s, _ in sorted(pieces[i])] == np.cumsum([0, *(n for _, n in sorted(pieces[i]))])[:-1].tolist()
        assert sum(n for _, n in pieces[i]) == len(tokens)
    for parts in windows.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist()
        assert sum(n for _, n in parts) <= 4096


def test_query_simhash(spark):
    texts = documents(spark)
    got = {r.doc_id: r for r in queries.op10_simhash(spark, SF).collect()}
    ids = sorted(texts)
    prints = [print_by_hand(texts[i]) for i in ids]
    assert [got[i].fingerprint for i in ids] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in ids] == [ids[k] for k in linked_by_hand(prints)]
