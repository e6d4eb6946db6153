"""The training-data operators against plain Python on small tables."""

from __future__ import annotations

import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanset.llm import (
    components,
    decontaminate,
    exact_dedup,
    html_main,
    html_pages,
    license_scan,
    packing,
    pii,
    pretokens,
    quality_crf,
    queries,
    simhash_vptree,
    token_counts,
    token_files,
)
from gleanset.session import scratch_path

ODD = [
    None,
    "",
    " \n\t ",
    "word",
    "Hello, WORLD's 12½ ÀÉÎ µ ª\x85x\xa0y\x1cz it'll ''s 'S",
    "<|endoftext|> in <|startoftext|>text<|endoftext|>",
    "日本語 текст İstanbul ΣΑΣ café café 　x 👩‍👩‍👧",
    "a" * 5000,
    "same text",
    "same text",
    "SAME TEXT",
]
DOC = "doc_id bigint, text string, note string, score double, _row bigint"


def table(spark, texts, tmp_path, name="docs", ids=None):
    """A written table with columns whose names clash with the operators' own."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "n", 0.5, 1) for i, t in zip(ids, texts)]
    path = str(tmp_path / name)
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_latin_pretokens_match_the_library_on_every_character():
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = pretokens.IdEncoder(name)
        texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2  {chr(c)} x{chr(c)}" for c in range(256)] + ODD[1:]
        for text, ids in zip(texts, encoder.encode(texts)):
            assert list(np.frombuffer(ids, "<u4")) == encoder.library.encode(text, add_special_tokens=False).ids, repr(text)


def test_whole_tokens_are_proven_and_counts_match(spark, tmp_path):
    library = pretokens.load("word_bpe_49k.json")
    proven = token_counts.whole_tokens("word_bpe_49k.json")
    assert len(proven) > 10_000
    for text in proven[::500]:
        assert len(library.encode(text, add_special_tokens=False).ids) == 1
    texts = [*ODD, "word " * 3000]
    got = {r.doc_id: r for r in token_counts.count_tokens(table(spark, texts, tmp_path)).collect()}
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 2048)


def test_counts_match_on_documents(spark):
    library = pretokens.load("word_bpe_49k.json")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op1_token_counts(spark, "/root/testdata/sf0.001").collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def pseudonymised(spark):
    texts = [
        None,
        "",
        "nothing here 4111111111111112 999.1.1.1 2021-02-30 000-12-3456",
        "4111 1111 1111 1111, 4111-1111-1111-1111 and 4111111111111111",
        "+1 (017) 555-7713 is (017) 555-7713",
        "IP 169.122.221.182. IBAN DE89 3704 0044 0532 0130 00 born 1980-02-29 or 29.02.1980",
        "Ask the.72@mail3.example.com### or THE.72@MAIL3.EXAMPLE.COM!!",
        'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" 078-05-1120',
        "4952935900253052 5949719 4952935900253052 +1 (136) 555-7479 161.17.88.162",
        "x " * 20000 + "4111111111111111",
    ]
    rows = [(i, t, "n") for i, t in enumerate(texts)]
    df = pii.pseudonymise(spark.createDataFrame(rows, "doc_id bigint, text string, found string"), "k")
    return texts, {r.doc_id: r for r in df.collect()}


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_pseudonyms_keep_the_format_and_link(pseudonymised):
    texts, got = pseudonymised
    for i in (0, 1, 2):
        assert got[i].text == texts[i] and got[i].found == []
    new = [re.sub(r"\D", "", f.pseudonym) for f in got[3].found]
    assert len(set(new)) == 1 and luhn(new[0]) and new[0] != "4" + "1" * 15
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}, \d{4}-\d{4}-\d{4}-\d{4} and \d{16}", got[3].text)
    assert got[9].text == "x " * 20000 + new[0]
    phones = [f.pseudonym for f in got[4].found]
    assert phones[0] == "+1 " + phones[1]
    kinds = {f.kind: f.pseudonym for f in got[5].found}
    assert set(kinds) == {"ipv4", "iban", "date"} and all(int(o) < 256 for o in kinds["ipv4"].split("."))
    iban = kinds["iban"].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    dates = [f.pseudonym for f in got[5].found if f.kind == "date"]
    assert dates[0] == "-".join(reversed(dates[1].split(".")))
    assert len({f.pseudonym for f in got[6].found}) == 1 and got[6].text.endswith("!!")
    assert [f.kind for f in got[7].found] == ["ssn"] and texts[7][:50] == got[7].text[:50]
    for i in range(3, 10):  # the spans are those of the original
        at, out = 0, ""
        for f in got[i].found:
            out += texts[i][at : f.start] + f.pseudonym
            at = f.start + f.length
        assert out + texts[i][at:] == got[i].text


def test_pseudonyms_are_a_permutation(spark):
    def permuted(column):
        return spark.range(100).select(pii._permuted("k", "t", column).alias("p")).distinct().count()

    assert permuted(F.lpad(F.col("id").cast("string"), 2, "0")) == 100
    days = spark.range(0, 212 * 212).select(F.date_add(F.lit("1905-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("d"))
    assert days.select(pii._date("k", F.col("d")).alias("p")).filter("p IS NOT NULL").distinct().count() == 212 * 212


def test_pseudonyms_of_dates_of_all_years_and_forms(spark):
    forms = {
        r"\d{4}-\d\d-\d\d": ["1899-12-31", "2035-06-01", "0000-02-29", "0001-01-01", "9999-12-31", "2028-01-20", "1904-12-31"],
        r"\d{4}-\d\d-\d\dT12:00:00Z": ["2024-05-01T12:00:00Z", "1899-12-31T12:00:00Z"],
        r"\d{4}/\d\d/\d\d": ["2024/05/01", "1899/12/31"],
        r"\d{4}\.\d\d\.\d\d": ["2024.05.01", "2035.06.01"],
        r"\d{4}/\d{1,2}/\d{1,2}": ["2024/5/1"],
        r"\d{1,2}\.\d{1,2}\.\d{4}": ["31.12.1899", "1.6.2035"],
    }
    texts = [(f"on {t}, yes", f"on {form}, yes") for form, own in forms.items() for t in own]
    kept = ["0001-02-29", "2035-02-30", "2024-05-01x", "2024.5.1", "2024/05/01/2"]
    rows = [(t,) for t, _ in texts] + [(t,) for t in kept]
    got = {r.old: r for r in pii.pseudonymise(spark.createDataFrame(rows, "text string").selectExpr("text AS old", "text"), "k").collect()}
    new = {}
    for old, form in texts:
        assert got[old].text != old and re.fullmatch(form, got[old].text)
        new[old[3:-5]] = [f.pseudonym for f in got[old].found if f.kind == "date"][0]
    assert all(got[t].text == t and got[t].found == [] for t in kept)
    day = lambda t: tuple(map(int, re.findall(r"\d+", t)))
    assert day(new["2024-05-01T12:00:00Z"]) == day(new["2024/05/01"]) == day(new["2024.05.01"]) == day(new["2024/5/1"])
    assert day(new["1899-12-31"]) == day(new["1899/12/31"]) == day(new["31.12.1899"])[::-1]
    assert day(new["2035-06-01"]) == day(new["2035.06.01"])
    # A permutation of all days beyond the near ones too.
    far = spark.range(0, 200_000).select(F.when(F.col("id") < 100_000, -1 - F.col("id")).otherwise(F.col("id")).cast("int").alias("n"))
    days = far.select(pii._day("k", F.col("n")).alias("d"))
    found = days.agg(F.count_distinct("d"), F.min("d"), F.max("d"), F.count_if(F.col("d").between(0, 212 * 212 - 1))).first()
    assert found[0] == 200_000 and found[1] >= -pii.BEFORE and found[2] < 3_652_425 - pii.BEFORE and found[3] == 0


def test_pseudonyms_use_no_python(spark):
    plan = queries.op2_pseudonyms(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_patience_alignment():
    assert [license_scan.increasing([3, 1, 2, 5, 4]), license_scan.increasing([])] == [[1, 2, 4], []]
    a, b = "x the a b the c d y".split(), "the a b the c d".split()
    assert license_scan.align(a, b) == [(i + 1, i) for i in range(6)]
    pairs = license_scan.align("p q r s t u".split(), "p q z s u".split())
    assert pairs == [(0, 0), (1, 1), (3, 3), (5, 4)]


def test_licenses(spark, tmp_path):
    mit = license_scan.TEMPLATES["MIT-text"]
    texts = [
        *ODD,
        f"start. {mit.replace('merge, ', '').upper()} end",
        "Released under the MIT License. Released under the MIT License.",
        "Licensed under CC BY-SA 4.0 is not the other one; released under no licence",
        "the and of " * 20000 + "Licensed under the Apache License, Version 2.0.",
        "released it. under what? the answer: not an MIT or a BSD License",
    ]
    got = {r.doc_id: r.licenses for r in license_scan.scan_licenses(table(spark, texts, tmp_path)).collect()}
    n = len(ODD)
    assert all(got[i] == [] for i in range(n)) and len(got) == len(texts)
    assert [h.name for h in got[n]] == ["MIT-text"] and 0.95 < got[n][0].coverage < 1
    assert [(h.name, texts[n + 1][h.start : h.end]) for h in got[n + 1]] == [("MIT", "Released under the MIT License")] * 2
    assert [h.name for h in got[n + 3]] == ["Apache-2.0"] and got[n + 4] == []


def test_reservations_and_short_notices(spark, tmp_path):
    names = license_scan.TEMPLATES
    own = ["All-rights-reserved", "BSD", "ISC", "LGPL-3.0", "LGPL-text", "AGPL-3.0", "AGPL-text", "CC0-1.0", "CC0-1.0-short"]
    wanted = [(f"Before it. {text} After it.", [name]) for name, text in names.items() if name in own or name.startswith("GPL")]
    wanted += [
        ("(c) 2020 A. Author. All Rights Reserved.", ["All-rights-reserved"]),
        ("Released under the MIT License. All rights reserved.", ["MIT", "All-rights-reserved"]),
        ("Released under the BSD License.", ["BSD"]),
        ("Distributed under the BSD 2-Clause License.", ["BSD-clause"]),
        ("To the extent possible under law, Jo Doe has waived all copyright and related or neighboring rights to Notes.", ["CC0-1.0"]),
        ("all rights are reserved; all seats reserved; rights reserved", []),
        ("under the GNU General Public License, version 2", []),
        ("under the licence of the BSD people", []),
    ]
    docs = table(spark, [t for t, _ in wanted], tmp_path)
    got = {r.doc_id: [h.name for h in r.licenses] for r in license_scan.scan_licenses(docs).collect()}
    assert [got[i] for i in range(len(wanted))] == [names for _, names in wanted]
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    reserved = {r.doc_id for r in documents.filter("text LIKE '%All rights reserved.%'").collect()}
    found = license_scan.scan_licenses(documents).filter("exists(licenses, x -> x.name = 'All-rights-reserved')").collect()
    assert reserved and reserved <= {r.doc_id for r in found}


def test_page_tree():
    nodes = html_main.tree("<p>a<b>b&amp;c</b> <br>d<p>e<script>x<p></script><!-- <p>no --><ul><li>f<li>g</ul>h</div>i")
    assert [(n.tag, n.parent, n.texts) for n in nodes] == [
        ("html", -1, [(4, "hi")]), ("p", 0, [(0, "ab&c d")]), ("p", 0, [(1, "e")]), ("ul", 0, []),
        ("li", 3, [(2, "f")]), ("li", 3, [(3, "g")]),
    ]


def test_page_tree_of_hidden_parts():
    def runs(page):
        return [(n.tag, t) for n in html_main.tree(page) for _, t in n.texts]

    for hidden in ("hidden", 'hidden=""', "HIDDEN", "hidden=until-found", "id=x hidden class='y'"):
        assert runs(f"<article><p {hidden}>x</p><p>real</p>more</article>") == [("article", "more"), ("p", "real")]
        assert runs(f"<section><div><div {hidden}>x<p>y</p></div>real</div>end</section>") == [("section", "end"), ("div", "real")]
        assert runs(f"<p>a <a {hidden}>x</a>real<p {hidden}>x<p>next") == [("p", "a real"), ("p", "next")]
    assert runs("<b><div hidden></b>x</div></b>real") == [("html", "real")]
    shown = ('title="a hidden gem"', "title='the hidden cost'", 'class="x hidden y"', "class= hidden", "data-hidden aria-hidden=true")
    for attribute in shown:
        assert runs(f"<article><p>a <a {attribute}>b</a> c</p><p {attribute}>d</p></article>")[-1] == ("p", "d")
        assert "".join(t for _, t in runs(f"<p>a <a {attribute}>b</a> c")) == "a b c"
    formula = "<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be <object data=f>one</object>."
    assert runs(formula) == [("p", "Let x=1 be one.")]


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(1)
    parent = np.array([-1, 0, 0, 1, 1, 2])
    depth, edge = np.array([0, 1, 1, 2, 2, 2]), np.array([0, 1, 0, 1, 0, 0])
    unary, steps = rng.normal(size=6), rng.normal(size=(2, 2, 2))
    forest = html_main.Forest([(np.zeros((6, 1)), parent, depth, edge)])
    belief, joint = forest.marginals(unary, steps)
    weight = {}
    for states in np.ndindex(*[2] * 6):
        score = sum(unary[i] * s for i, s in enumerate(states))
        weight[states] = np.exp(score + sum(steps[edge[i], states[parent[i]], states[i]] for i in range(1, 6)))
    total = sum(weight.values())
    for i in range(6):
        assert np.isclose(np.exp(belief[i, 1]), sum(w for s, w in weight.items() if s[i]) / total)
    for i in range(1, 6):
        assert np.isclose(joint[i, 1, 0], sum(w for s, w in weight.items() if s[parent[i]] and not s[i]) / total)


def test_main_text(spark):
    model = html_pages.trained()
    writer = html_pages.Writer(7)
    right = 0
    for _ in range(200):  # pages of another seed
        nodes, label = html_pages.labelled(writer.page())
        found = model.content([html_main.features(nodes)])[0]
        right += html_main.text_of(nodes, found) == html_main.text_of(nodes, label)
    assert right >= 190
    rows = [(0, None, "u"), (1, "", "u"), (2, "<p>", "u"), (3, "<div>" * 3000 + "x", "u"), (4, "&am < <a", "u")]
    df = spark.createDataFrame(rows, "page_id int, html string, main_text string")
    got = {r.page_id: r.main_text for r in html_main.extract_main_text(df, model).collect()}
    assert len(got) == 5 and got[0] == got[1] == got[2] == ""


def test_main_text_of_the_given_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    wrong = 0
    for r in queries.op4_main_text(spark, "/root/testdata/sf0.01").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html_main.html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        wrong += r.text != "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)
    assert wrong <= 2


def test_perfect_hash():
    for n in (0, 1, 2, 1000, 50_000):
        hashes = token_files.key_hash(list(range(n)), 0)
        perfect = token_files.PerfectHash.build(hashes)
        assert sorted(perfect.slots(hashes)) == list(range(n))


def test_store_round_trip_and_keyed_access(spark, tmp_path):
    texts = [*ODD, *(f"text number {i}" for i in range(300))]
    ids = [None, *range(len(texts) - 3, 0, -1), 7, 7]
    docs = table(spark, texts, tmp_path, ids=ids)
    path = scratch_path(spark, "store")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_store(docs, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    library = pretokens.load("byte_bpe_50k.json")
    want = sorted((-1 if i is None else i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in zip(ids, texts))
    rows = token_files.read_store(spark, path).orderBy("start").collect()
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    assert sorted((-1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == want
    assert [r.doc_id for r in rows] == sorted([r.doc_id for r in rows], key=lambda k: -1 if k is None else k)
    shards = token_files.shards(spark, path).collect()
    assert len(shards) > 1
    for s in shards:
        shard = token_files.Shard(path, s.shard)
        for key in set(shard.keys):
            here = [np.frombuffer(r.ids, "<u4").tolist() for r in rows if r.doc_id == key]
            assert all(g.tolist() in here for g in shard.get(key)) and shard.get(key)
        assert not any(shard.get(k) for k in range(10_000, 11_000))
    ids, = (r.ids for r in rows if r.start == 0)
    assert token_files.crc32(np.frombuffer(ids, "<u4")) == zlib.crc32(ids)


def test_empty_store(spark, tmp_path):
    path = scratch_path(spark, "store")
    token_files.write_store(table(spark, [], tmp_path), path)
    assert token_files.read_store(spark, path).collect() == []


def test_tightest_window_is_found():
    rng = np.random.default_rng(0)
    windows, rooms = packing.OpenWindows(100), []
    for _ in range(3000):
        need = int(rng.integers(1, 101))
        fits = [r for r in rooms if r >= need]
        found = windows.tightest(need)
        assert (found[0] if found else None) == min(fits, default=None)
        if found:
            rooms.remove(found[0])
        room = int(rng.integers(1, 101))
        windows.put(room, None)
        rooms.append(room)


def check_packing(rows, want, capacity):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(want)
    for doc, ids in want.items():
        own = sorted(pieces[doc], key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == ids
        assert all(r.doc_tokens == len(ids) and r.length == len(r.ids) // 4 > 0 for r in own)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / sum(len(i) for i in want.values())


def test_packing(spark, tmp_path):
    library = pretokens.load("word_bpe_49k.json")
    texts = [*ODD, "long text " * 10_000, *("w " * n for n in range(0, 900, 7))]
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    docs = table(spark, texts, tmp_path)
    assert check_packing(packing.pack_documents(docs).collect(), want, 4096) < 0.02
    assert check_packing(packing.pack_documents(docs, capacity=64, block=500, slack=4, open_windows=8).collect(), want, 64) < 0.07
    assert packing.pack_documents(table(spark, [], tmp_path, "none")).collect() == []


@pytest.mark.parametrize("open_windows", [0, 1, 8])
@pytest.mark.parametrize("sizes", [[51], [34], [51, 60, 99], [51, 130, 7, 45]])
def test_windows_that_give_way_are_full(sizes, open_windows):
    packer = packing.Packer(100, 2000, 4, open_windows)
    docs = {i: np.full(sizes[i % len(sizes)], i, "<u4") + 1000 * np.arange(sizes[i % len(sizes)], dtype="<u4") for i in range(1000)}
    closed = [w for i, ids in docs.items() for w in packer.add(i, ids.tobytes())]
    assert packer.windows.count <= max(1, open_windows)
    filled = [sum(len(p[3]) // 4 for p in w) for w in closed]
    assert len(filled) > 300 and all(96 <= f <= 100 for f in filled)
    closed += packer.finish()
    pieces = sorted((doc, start, total, ids) for w in closed for doc, start, total, ids in w)
    for doc, ids in docs.items():
        own = [p for p in pieces if p[0] == doc]
        assert b"".join(p[3] for p in own) == ids.tobytes() and all(p[2] == len(ids) and p[3] for p in own)
        assert [p[1] for p in own] == np.cumsum([0, *[len(p[3]) // 4 for p in own]])[:-1].tolist()


def hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, found = set(), set()
    for item, body in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), body or ""))
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                places |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(places), sorted(found)


def test_decontamination(spark, tmp_path):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(words, n))
    items = [(i, text(int(n))) for i, n in enumerate(rng.integers(0, 30, 25))] + [(30, None), (31, "solo"), (31, "É"), (None, "only null")]
    texts = [*ODD, *(text(int(n)) for n in rng.integers(0, 60, 40)), items[3][1].upper(), "x " + "! ".join(str(t) for _, t in items), "Solo é", "only NULL"]
    texts.append(" ".join(f"{items[5][1]} {text(5)}" for _ in range(300)))
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {r.doc_id: r for r in decontaminate.find_contamination(table(spark, texts, tmp_path), bench).collect()}
    for i, t in enumerate(texts):
        n, hit, found = hits(t, items)
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (n, hit, [f for f in found if f != "None"]), i
    assert sum(r.n_hit > 0 for r in got.values()) > 5
    none = spark.createDataFrame([], "item_id int, text string")
    assert {r.n_hit for r in decontaminate.find_contamination(table(spark, texts, tmp_path, "again"), none).collect()} == {0}
    assert decontaminate.find_contamination(table(spark, [], tmp_path, "empty"), bench).collect() == []


def test_chain_marginals_are_exact():
    rng = np.random.default_rng(2)
    unary, step = rng.normal(size=(1, 4)), rng.normal(size=(2, 2))
    model = quality_crf.LineCrf(None, None, None, None, step)
    good, pairs, total = model.marginals(np.concatenate([unary, np.zeros((1, 4))]), np.array([4, 1]))
    weight = {
        s: np.exp(sum(unary[0, i] * x for i, x in enumerate(s)) + sum(step[a, b] for a, b in zip(s, s[1:])))
        for s in np.ndindex(2, 2, 2, 2)
    }
    z = sum(weight.values())
    assert np.isclose(total[0], np.log(z))
    for i in range(4):
        assert np.isclose(good[0, i], sum(w for s, w in weight.items() if s[i]) / z)
    assert np.isclose(pairs[0, 1], sum(w * sum((a, b) == (0, 1) for a, b in zip(s, s[1:])) for s, w in weight.items()) / z)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op8_quality(spark, sf).filter("held_out").join(labels, "doc_id").collect()
    y, p = np.array([r.quality for r in rows]), np.array([r.score for r in rows])
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    rank = p.argsort().argsort()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.98 and np.mean([r.predicted == r.quality for r in rows]) > 0.98


def test_quality_of_odd_texts(spark, tmp_path):
    docs = table(spark, [*ODD, "\n" * 50_000, "x\n" * 3000], tmp_path)
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(12)] + [(None, 1, 1), (3, None, 1)], "doc_id bigint, quality int, text int")
    model = quality_crf.train(docs, labels)
    got = quality_crf.with_scores(docs, model).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[0] == by_id[1] and by_id[8] == by_id[9]
    assert quality_crf.train(docs, labels.limit(0)) == 0.5
    assert quality_crf.with_scores(docs.limit(0), 0.5).collect() == []
    assert quality_crf.drop_low_quality(docs, labels).columns == docs.columns


def exact_by_hand(texts, ids):
    groups: dict = {}
    for i, t in zip(ids, texts):
        groups.setdefault(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""), []).append(i)
    return {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}


def test_exact_groups(spark, tmp_path):
    base = "prefix " * 400
    texts = [*ODD, *[base + s for s in ("a", "b", "a", "A", "É", "é", "")], base[:64], base[:64].upper(), "Ä" * 70, "Ä" * 70, "z" * 70_000, "Z" * 70_000, "z" * 69_999 + "y"]
    texts += ["hot " * 30] * 50
    got = exact_dedup.exact_groups(table(spark, texts, tmp_path)).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == exact_by_hand(texts, range(len(texts)))
    assert len(got) == len(texts)


def test_exact_copies_with_repeated_and_null_ids(spark, tmp_path):
    docs = table(spark, ["t", "t", "t", "u", "u", None, ""], tmp_path, ids=[5, 5, 1, None, None, None, 2])
    rows = exact_dedup.exact_groups(docs).collect()
    assert sorted((r.group_size, r.keep_id or 0, r.kept) for r in rows) == [
        (2, 0, False), (2, 0, True), (2, 2, False), (2, 2, True), (3, 5, False), (3, 5, False), (3, 5, True),
    ]
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 5]
    assert exact_dedup.exact_groups(table(spark, [], tmp_path, "none")).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 201), (201, 200), (5, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(41), 300], 0), 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def linked_by_hand(prints, distance=3):
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (int(prints[i]) ^ int(prints[j])).bit_count() <= distance:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return [top(i) for i in range(len(prints))]


def clustered(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    near = base[: n // 2].copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
    dense = base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    return np.unique(np.concatenate([base, near, dense]))


def test_every_link_meets_in_a_shard():
    prints = clustered(5, 1500)
    tree = simhash_vptree.VantageTree(prints[::3], 16, 3)
    assert (tree.radii < 0).sum() > 4
    index, shard = tree.shards(prints)
    homes = [set() for _ in prints]
    for i, s in zip(index, shard):
        homes[i].add(s)
    near = np.argwhere(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3)
    assert all(homes[i] & homes[j] for i, j in near)


def test_links_connect_what_brute_force_links(spark, monkeypatch):
    prints = clustered(6, 1500)
    want = linked_by_hand(prints)
    labels = simhash_vptree.forest(prints, 3)
    assert labels.tolist() == want
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "_print long").repartition(3)
    at = {int(p): i for i, p in enumerate(prints.view(np.int64))}
    monkeypatch.setattr(simhash_vptree, "LEVELS", 2)  # so that shards are too large and cut into blocks
    for shard in (100_000, 300, 60):
        found = components.components(simhash_vptree.links(df, 3, shard)).collect()
        groups: dict = {}
        for r in found:
            groups.setdefault(r.root, set()).add(at[r.node])
        expected: dict = {}
        for i, w in enumerate(want):
            expected.setdefault(w, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)


def print_by_hand(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_groups(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = [*ODD, *(r.text for r in docs)]
    prints = [print_by_hand(t) for t in texts]
    want = linked_by_hand(prints)
    path = table(spark, texts, tmp_path)
    got = {r.doc_id: r for r in simhash_vptree.near_groups(path).collect()}
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == want
    kept = simhash_vptree.drop_near_copies(path)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == path.columns
    repeated = table(spark, ["a b c d", "a b c d", None, "x"], tmp_path, "ties", ids=[4, 4, None, None])
    rows = simhash_vptree.near_groups(repeated).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (0, 0), (4, 4), (4, 4)]
    assert simhash_vptree.near_groups(table(spark, [], tmp_path, "none")).collect() == []


def test_near_copies_with_repeated_and_null_ids(spark, tmp_path):
    unlike = [f"{w} one {w} two {w} three {w} four {w} five" for w in "ant bee cow dog".split()]
    docs = table(spark, [*unlike, unlike[0], unlike[2]], tmp_path, ids=[None, None, 4, 4, None, 4])
    kept = simhash_vptree.drop_near_copies(docs).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted(zip([0, 0, 4, 4], unlike))
