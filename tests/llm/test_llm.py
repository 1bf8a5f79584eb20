import os
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.llm import encoding, frequency, leakage, markup, pages, pii, residue, sentences, spans

NAMES = [("Maria", "given"), ("Ingrid", "given"), ("Velkin", "family"), ("Ashcombe-Ruel", "family")]
VOCABULARY = os.environ.get("WORDLOOM_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")


# frequency

def test_ledger_equals_recount_after_changes(spark):
    rnd = random.Random(3)
    text = lambda: rnd.choice([None, "", " ".join(rnd.choice(["aa", "hot", "Word", "x_y", "gpt4", "naïve", "tree"]) for _ in range(rnd.randrange(9)))])
    rows = {i: text() for i in range(120)}
    mk = lambda d: spark.createDataFrame([(v, "n") for v in d], "body string, term string")
    ledger = frequency.TermLedger(spark, merge_after=2)
    ledger.apply("body", added=mk(rows.values()), value="body", tokenized=True)
    for _ in range(3):
        keys = rnd.sample(sorted(rows), 30)
        old, new = [rows[k] for k in keys], [text() for _ in keys]
        rows.update(zip(keys, new))
        ledger = frequency.TermLedger.open(spark, ledger.path)  # another object, as in another session
        ledger.apply("body", added=mk(new), removed=mk(old), value="body", tokenized=True)
    occ, docs = Counter(), Counter()
    for t in rows.values():
        w = [x for x in re.findall(r"\w+", (t or "").lower()) if re.fullmatch("[a-z]{3,}", x)]
        occ.update(w)
        docs.update(set(w))
    assert {r["term"]: (r["occurrences"], r["records"]) for r in ledger.counts().collect()} == {t: (occ[t], docs[t]) for t in occ}
    assert ledger.totals().head()["total"] == sum(v is not None for v in rows.values())


def test_small_changes_leave_the_large_counts_alone(spark):
    ledger = frequency.TermLedger(spark, merge_after=3, tier=4)
    big = spark.createDataFrame([(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}",) for i in range(400)], "v string")
    ledger.apply("s", added=big, value="v", tokenized=False)
    base = ledger.parts[0]["name"]
    for _ in range(4):
        ledger.apply("s", added=big.limit(3), removed=big.limit(1), value="v", tokenized=False)
    assert ledger.parts[0]["name"] == base and len(ledger.parts) < 4
    assert ledger.counts().agg({"occurrences": "sum"}).head()[0] == 400 + 4 * 2


def test_marks_and_empty_ledger(spark):
    assert frequency.marked_terms(frequency.TermLedger(spark), {}).count() == 0
    ledger = frequency.TermLedger(spark)
    ledger.apply("s", added=spark.createDataFrame([("",)] * 3 + [("b",)] + [(None,)] * 9, "v string"), value="v", tokenized=False)
    assert {r["term"]: r["mark"] for r in frequency.marked_terms(ledger, {"s": (2, 0)}).collect()} == {"": "common", "b": "rare"}


# spans

def brute_pairs(rows, k):
    out = set()
    for i, (a, ta, xa) in enumerate(rows):
        for b, tb, xb in rows[i + 1 :]:
            if ta != tb and xa and xb and {xa[p : p + k] for p in range(len(xa) - k + 1)} & {xb[p : p + k] for p in range(len(xb) - k + 1)}:
                out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("hot", [1_000_000, 0])
def test_pairs_and_extents_against_brute_force(spark, hot):
    rnd, k = random.Random(5), 12
    word = lambda n: "".join(rnd.choice("abcdé😀 ") for _ in range(n))
    shared = [word(n) for n in (12, 13, 30, 11)]
    rows = [(i, rnd.randrange(25), word(rnd.randrange(0, 40)) + rnd.choice(shared + [""]) + word(rnd.randrange(0, 20))) for i in range(60)]
    rows += [(100, 1, None), (101, 1, ""), (102, 2, "aaaa" * 20), (103, 3, "aaaa" * 20), (104, 3, "a" * 11)]
    s = spans.SharedSpans(spark.createDataFrame(rows, "row long, thread long, text string"), k=k, hot=hot)
    pairs = brute_pairs(rows, k)
    assert {tuple(r) for r in s.pairs().collect()} == pairs
    members: dict[int, set] = {}
    for r in s.members().collect():
        members.setdefault(r["class"], set()).add((r["row"], r["thread"]))
    assert {(a, b) for m in members.values() for a, ta in m for b, tb in m if a < b and ta != tb} == pairs and len({frozenset(m) for m in members.values()}) == len(members)
    for r in s.classes().collect():
        m = members[r["class"]]
        assert (r["records"], r["threads"], r["links"]) == (len(m), len({t for _, t in m}), sum(a < b and ta != tb for a, ta in m for b, tb in m))
    got = {r["row"]: r["shared_chars"] for r in s.extents().collect()}
    for row, thread, text in rows:
        others = {x[p : p + k] for r, t, x in rows if t != thread and x for p in range(len(x) - k + 1)}
        on = {c for p in range(len(text or "") - k + 1) if text[p : p + k] in others for c in range(p, p + k)}
        assert got.get(row, 0) == len(on)


def test_spans_of_empty_table(spark):
    assert spans.SharedSpans(spark.createDataFrame([], "row long, thread long, text string")).pairs().count() == 0


def test_long_text_is_cut_without_loss():
    rnd = random.Random(2)
    t = "".join(rnd.choice("abcdefgh") for _ in range(spans._SEGMENT + 3000))
    no, mini, start, length = spans.super_windows([t], 240, 120)
    assert int((length - 239).sum()) == len(t) - 239
    assert sorted(start)[0] == 0 and max(start + length) == len(t)


# personal information

@pytest.mark.parametrize(
    "text,kinds",
    [
        ("Write to l_calderane+chat@harborpost.test now", {"email"}),
        ("maria (at) mail (dot) example (dot) net or x.y [at] loft.example if", {"email"}),
        ("nadia AT nettle DOT invalid", {"email"}),
        ("Look at me. Dot your eyes at home", set()),
        ("helper-kit@5.9.6 root@box @mod_usa", set()),
        ("+49 30 23125 141", {"phone"}),
        ("call (202) 555-0184 or 030/23125869", {"phone"}),
        ("two oh two, five five five, oh one four six", {"phone"}),
        ("Order 9981-25-6040, build 10.0.18980.853, checksum 9446255416ab, Ticket 2025-8443-51", set()),
        ("passport no. ZZ5580906", {"id_number"}),
        ("my SSN 930 70 6079", {"id_number"}),
        ("insured person 934354625 (the social security one)", {"id_number"}),
        ("Steuer-ID 00 395 967 320", {"id_number"}),
        ("Flat 22, 61 Selpa Close, Oldbarrow ZZ53 9ZZ", {"address"}),
        ("666 Gadel Ave, Pinecrook, ME 00040", {"address"}),
        ("Zabrastraße 11, 00069 Ravensmere", {"address"}),
        ("P.O. Box 292, Marlowick", {"address"}),
        ("Chapter 10 plays in a street without a name.", set()),
        ("Maria told me to try the other tier.", set()),
        ("My name is Nadia R. Korvale and I teach", {"person"}),
        ("Velkin, Maria said; SIGNED INGRID VELKIN", {"person"}),
        ("so i'm ingrid ashcombe-ruel and", {"person"}),
        ("Dr. Felmoor said the same thing", {"person"}),
        ("", set()),
        (None, set()),
        ("   ", set()),
    ],
)
def test_kinds(text, kinds):
    assert {k for _, _, k in pii.Finder(NAMES).spans(text)} == kinds


def test_redaction_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "a Maria Velkin b\nx@y.example"), (2, None), (3, ""), (4, "n" * 100_000)], "row_id long, body string")
    got = {r["row_id"]: r["redacted"] for r in pii.redact(df, NAMES, text="body").collect()}
    assert got == {1: "a [PERSON] b\n[EMAIL]", 2: None, 3: "", 4: "n" * 100_000}
    assert pii.find_kinds(df.limit(0), NAMES, text="body").count() == 0
    with pytest.raises(ValueError):
        old, pii.MAX_NAMES = pii.MAX_NAMES, 1
        try:
            pii.read_names(spark.createDataFrame(NAMES, "name string, name_kind string"))
        finally:
            pii.MAX_NAMES = old


# markup

@pytest.mark.parametrize(
    "text,want",
    [
        ("<b>x</b> &amp; y", ["html"]),
        ("<!-- a -->", ["html"]),
        ("My patience is < 4 and its hedging > 87. x = y <%= a %> <|endoftext|>", []),
        ("# Title\n\ntext", ["markdown"]),
        ("Title\n=====", ["markdown"]),
        ("- a\n- b", ["markdown"]),
        ("1. a\n2. b", ["markdown"]),
        ("I *like* it", ["markdown"]),
        ("9 * 4 * 3 tries, C# people and A* people, turn_count_x, #1 fans", []),
        ("see `x` and ~~y~~", ["markdown"]),
        ("> quoted", ["markdown"]),
        ("== Head ==\n[[A|b]] '''c'''", ["wiki"]),
        ('{| class="wikitable"\n|-\n| a || 1\n|}', ["wiki"]),
        ("{{Infobox chat|turns=41}}", ["wiki"]),
        ("Hi {{first_name}}, {title} ${post.title} by ${post.author}", []),
        (r"\textbf{a} and $r_{2}$", ["latex"]),
        ("I paid $20 in May and $25 in June.", []),
        ("https://a.b/c and it's ''", []),
        (None, []),
        ("", []),
    ],
)
def test_markup(text, want):
    assert markup.markup_of(text) == want


def test_clean_keeps_structure(spark):
    t = "<h2>Head</h2><ul><li>a</li><li>b &amp; c</li></ul>\n\n**bold** [l](http://x.y)\n\n```\n*code*\n```\n\n\\section{S}\n$x_{1}$ == no"
    out = markup.clean(t)
    assert "# Head" in out and "- a" in out and "b & c" in out and "*code*" in out and "# S" in out and "$x_{1}$" in out and "**" not in out and "http" not in out
    df = spark.createDataFrame([(1, None), (2, "plain < text")], "row_id long, t string")
    assert {r[0]: r[1] for r in markup.clean_markup(df, text="t").collect()} == {1: None, 2: "plain < text"}


# pages

def test_common_lines_are_a_longest_subsequence():
    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
    def check(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        at = pages.common_lines(a, b)
        it = iter(b)
        assert len(at) == best[-1][-1] and at == sorted(set(at)) and all(any(x == y for y in it) for x in (a[i] for i in at))

    check()


def test_pages_lose_the_frame_of_their_host(spark):
    frame = "Menu\n\nHome\n{}\nImprint"
    rows = [(1, "https://A.example/x/one", frame.format("first\ntext")), (2, "https://a.example/x/two", frame.format("second")), (3, "https://a.example/y", "Other\npage"), (4, "https://b.example/", frame.format("alone")), (5, None, "no address"), (6, "https://a.example/x/one", None), (7, "https://c.example", ""), (8, "https://c.example", "same"), (9, "https://c.example", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, text string")
    got = {r["page_id"]: (r["clean_text"], r["removed"]) for r in pages.difference_pages(df).collect()}
    assert got[1] == ("\nfirst\ntext", 3) and got[2] == ("\nsecond", 3) and got[3][1] == 0 and got[4][1] == 0 and got[5] == ("no address", 0) and got[6] == (None, 0)
    assert got[8] == ("same", 0) and got[9] == ("", 1) and len(got) == 9  # the neighbour before is taken on a tie
    assert pages.difference_pages(df.limit(0)).count() == 0


# markup kept

def test_clean_text_keeps_structure_in_every_language():
    heads, items, code, formula = ["Alpha part", "Beta part"], ["first thing", "second thing"], "x = y < 3", "$\\frac{a}{b} = c_1$"
    forms = {
        "html": "".join(f"<h2>{h}</h2>" for h in heads) + "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul><pre><code>x = y &lt; 3</code></pre><p>" + formula + "</p>",
        "markdown": "\n".join(f"## {h}\n" for h in heads) + "\n" + "\n".join(f"* {i}" for i in items) + f"\n\n```\n{code}\n```\n\n{formula}",
        "wiki": "\n".join(f"== {h} ==" for h in heads) + "\n" + "\n".join(f"* {i}" for i in items) + f"\n<pre>{code.replace('<', '&lt;')}</pre>\n[[Page|shown]] {formula}",
        "latex": "\n".join(f"\\section{{{h}}}" for h in heads) + "\n\\begin{itemize}\n" + "\n".join(f"\\item {i}" for i in items) + f"\n\\end{{itemize}}\n`{code}`\n{formula}",
    }
    for name, text in forms.items():
        out = markup.clean(text)
        lines = [x.strip() for x in out.splitlines()]
        assert all(f"# {h}" in lines for h in heads) and all(f"- {i}" in lines for i in items) and code in out and formula in out, (name, out)
        assert not re.search(r"</?(?:h2|ul|li|pre|code|p)>|==|\\(?:section|item|begin|end)", out), (name, out)


# residue

def test_residue_held_out_accuracy(spark):
    rnd = random.Random(1)
    topics, verbs = ["the recipe", "my diary", "the map", "a poem", "the quiz"], ["ignored", "praised", "forgot", "rewrote"]
    post = lambda: " ".join(f"The bot {rnd.choice(verbs)} {rnd.choice(topics)} and I took a walk." for _ in range(rnd.randrange(1, 5)))
    junk = [lambda: "Lorem ipsum " + " ".join(rnd.choice(["velor", "tulis", "nisca"]) for _ in range(12)) + ".", lambda: f"Error {rnd.choice([404, 502])}: the page is gone. Request id {rnd.randrange(10**7)}", lambda: "Hi {{first_name}}, your topic {{topic}} was received."]
    rows = [(i, post()) for i in range(600)] + [(1000 + i, rnd.choice(junk)()) for i in range(90)] + [(3000, None), (3001, " "), (3002, "[removed]"), (3003, post() + " It filled the draft with lorem ipsum once. " + post())]
    rows += [(2000 + i, "Velor tulis nisca velor nisca tulis velor.") for i in range(5)]
    df = spark.createDataFrame(rows, "row_id long, body string")
    got = {r[0] for r in residue.find_residue(df, residue.fit(df, text="body"), text="body").collect()}
    assert got == {i for i, _ in rows if 1000 <= i < 3000}
    assert residue.find_residue(df.limit(0), residue.fit(df.limit(0), text="body"), text="body").count() == 0


def test_residue_finds_forms_that_no_trusted_record_has(spark):
    rnd = random.Random(5)
    who, verbs, what, ends = ["the bot", "my assistant", "our tutor", "that model"], ["ignored", "praised", "forgot", "rewrote", "quoted"], ["the recipe", "my diary", "the map of the island", "a poem", "the quiz"], ["and I took a walk", "before lunch", "so we laughed", "for no reason", "on the phone"]
    post = lambda: " ".join(f"{rnd.choice(who).capitalize()} {rnd.choice(verbs)} {rnd.choice(what)} {rnd.choice(ends)}." for _ in range(rnd.randrange(1, 6)))
    known = [lambda: f"Error {rnd.choice([404, 502])}: upstream gone. Request id {rnd.randrange(10**7)}", lambda: "Hi {{first_name}}, your topic {{topic}} was received.", lambda: "Please enable JavaScript to see this page.", lambda: "Checking your browser... token " + str(rnd.randrange(10**8)), lambda: "Access denied. Reference " + str(rnd.randrange(10**8)), lambda: "asdf " * rnd.randrange(2, 8)]
    new = [lambda: f"Start | Topics | Sign in\n\nNothing was found there.\n\nCase {rnd.randrange(10**7)}", lambda: "@@HEAD@@ :: @@BODY@@", lambda: "qwer " * rnd.randrange(4, 9), lambda: "Insert copy here. Overwrite it before release."]
    assert not any(residue.TRUSTED.search(f()) for f in new)
    rows = [(i + 10_000, post()) for i in range(4000)] + [(2000 + i, rnd.choice(known)()) for i in range(120)] + [(3000 + i, new[i % 4]()) for i in range(40)]  # each new form in a 400th of the rows
    rows += [(4000, post() + " Access denied. That is all it said. " + post()), (4001, "A lost title [removed]"), (4002, None), (4003, post() + " " + "word " * 60_000)]
    df = spark.createDataFrame(rows, "row_id long, body string")
    got = {r[0] for r in residue.find_residue(df, residue.fit(df, text="body"), text="body").collect()}
    held = {i for i, _ in rows if 3000 <= i < 4000}
    assert {i for i, _ in rows if 2000 <= i < 3000} <= got and not {i for i in got if i >= 10_000 or 4000 <= i < 4003}
    assert len(got & held) >= 0.95 * len(held)


# encoding

@needs_vocabulary
def test_encoding_equals_the_public_library():
    tiktoken = pytest.importorskip("tiktoken")
    e = encoding.PrefixEncoder(VOCABULARY)
    ref = tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=e.ranks, special_tokens={})

    @settings(max_examples=200, deadline=None)
    @given(st.text(max_size=80) | st.text("ab '\n 1é中ก<|endoftext|>", max_size=60), st.integers(0, 60), st.integers(0, 20), st.text(max_size=8))
    def check(t, a, n, new):
        t, new = (x.encode("utf-8", "ignore").decode() for x in (t, new))
        ids = e.encode(t)
        assert ids == ref.encode_ordinary(t)
        kept = encoding.EncodedText(e, t)
        for start, size, put in ((a, n, new), (a + 3, n // 2, new[::-1]), (0, 1, "x")):
            start = min(start, len(kept.text))
            kept.edit(start, min(start + size, len(kept.text)), put)
            assert kept.ids == ref.encode_ordinary(kept.text)
        kept.append(new + t)
        assert kept.ids == ref.encode_ordinary(kept.text)

    check()
    assert e.encode(None) == e.encode("") == encoding.EncodedText(e, None).ids == []


@needs_vocabulary
def test_an_edit_encodes_only_what_is_near():
    e = encoding.PrefixEncoder(VOCABULARY)
    kept = encoding.EncodedText(e, "some words here, " * 30_000)
    kept.edit(200_000, 200_003, "tokenization")
    assert 0 < kept.encoded <= 10 and kept.ids == e.encode(kept.text)
    kept.append(" more")
    assert kept.encoded <= 10 and kept.ids == e.encode(kept.text)
    long = encoding.EncodedText(e, "abcdefghij" * 3_000)  # one piece
    calls = []
    fits = e.fits
    e.fits = lambda a, b: calls.append(1) or fits(a, b)
    long.edit(15_000, 15_001, "Q")
    assert len(calls) < 15_000 and long.ids == e.encode(long.text)


def test_a_vocabulary_without_a_byte_is_refused(tmp_path):
    import base64

    path = tmp_path / "v"
    path.write_bytes(b"".join(base64.b64encode(bytes([c])) + b" %d\n" % i for i, c in enumerate(b"abc")))
    e = encoding.PrefixEncoder(str(path))
    assert e.encode("abca") == [0, 1, 2, 0]
    with pytest.raises(ValueError):
        e.encode("abd")


@needs_vocabulary
def test_encode_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "x" * 20_000)], "doc_id long, text string")
    got = [(r["doc_id"], len(r["ids"])) for r in encoding.encode_texts(df, VOCABULARY).orderBy("doc_id").collect()]
    assert got[:4] == [(1, 0), (2, 0), (3, 2), (3, 2)] and got[4][1] > 0


# personal information of any length

def test_anchors_expand_to_the_bounds_of_their_tokens():
    f = pii.Finder(NAMES)
    long = "a" * 10_000
    assert f.redact(f"write {long}@example.com now") == "write [EMAIL] now"
    assert f.redact("write x@" + "sub." * 3_000 + "example.com now") == "write [EMAIL] now"
    assert f.redact(f"Maria {long.capitalize()} wrote") == "[PERSON] wrote"
    assert f.redact(f"{long.capitalize()} Velkin wrote") == "[PERSON] wrote"
    assert f.redact("see mailto:x.y@example.org?subject=z, tel:+49-30-1234567 or tel:12") == "see mailto:[EMAIL]?subject=z, tel:[PHONE] or tel:12"
    assert f.redact(f"at 12 {long.capitalize()} Street, Leeds LS1 4AB today") == "at [ADDRESS] today"


def test_names_of_a_large_lexicon_come_by_record(spark):
    names = spark.createDataFrame([*NAMES, (None, "given")], "name string, name_kind string")
    rows = [(1, "Maria Velkin wrote, then ingrid velkin."), (2, None), (3, ""), (4, "Dr. Ashcombe-Ruel and nobody"), (5, "the velkin street")]
    df = spark.createDataFrame(rows, "row_id long, text string")
    out = [{(r["row_id"], r["redacted"]) for r in pii.redact(df, names, text="text", most=most).collect()} for most in (100, 1)]
    assert out[0] == out[1] and (1, "[PERSON] wrote, then [PERSON].") in out[0]


# leakage

def test_leaks_against_brute_force(spark):
    rnd, n = random.Random(7), 4
    vocab = [f"w{i}" for i in range(9)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(2, 15)))) for i in range(12)] + [(99, None), (98, "")]
    docs = [(i, " ".join(rnd.choice(vocab + ["zz", "Q!"]) for _ in range(rnd.randrange(0, 40)))) for i in range(80)] + [(500, None), (501, ""), (0, "dup")]
    docs += [(600, items[0][1].upper().replace(" ", "... "))] * 2
    grams = lambda t: {tuple(w[k : k + n]) for w in [leakage.words_of(t or "")] for k in range(len(w) - n + 1)}
    want = {(d, i) for d, t in docs for i, x in items if grams(t) & grams(x)}
    mk = lambda r, c: spark.createDataFrame(r, f"{c} long, text string")
    for size, block in ((400_000, 50_000), (30, 5), (6, 50_000)):  # the last cuts documents
        out = leakage.leaked(mk(docs, "doc_id"), mk(items, "item_id"), n=n, shard_words=size, item_block=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in out} == want
    for r in out:
        assert r["to_word"] - r["from_word"] >= n
    assert leakage.leaked(mk([], "doc_id"), mk(items, "item_id")).count() == 0
    assert leakage.leaked(mk(docs, "doc_id"), mk([], "item_id")).count() == 0


def test_an_index_of_shards_is_opened_for_another_benchmark(spark, tmp_path):
    mk = lambda r, c: spark.createDataFrame(r, f"{c} long, text string")
    docs = mk([(1, "one two three four five six"), (2, "six five four three two one"), (3, None)], "doc_id")
    path = leakage.ShardIndex.build(docs, f"file://{tmp_path}/shards").path
    for items, want in (([(7, "two three four")], {(1, 7, 1, 4)}), ([(8, "Five, four, THREE two")], {(2, 8, 1, 5)}), ([(9, "absent words here")], set())):
        assert {tuple(r) for r in leakage.ShardIndex.open(spark, path).search(mk(items, "item_id"), n=3).collect()} == want


# sentences

@pytest.mark.parametrize(
    "text,units",
    [
        ("Hello there. It works!", ["Hello there.", "It works!"]),
        ("Dr. Felmoor agreed, e.g. on p. 4, at 2 p.m. sharp. Then i.e. done.", ["Dr. Felmoor agreed, e.g. on p. 4, at 2 p.m. sharp.", "Then i.e. done."]),
        ("It took until 2 p.m. If so, fine.", ["It took until 2 p.m.", "If so, fine."]),
        ('It said "no!" again. (I am serious! it did!) ok.', ['It said "no!" again.', "(I am serious! it did!) ok."]),
        ("See notes.example.org/a?id=25, v2.6.1. Next.", ["See notes.example.org/a?id=25, v2.6.1.", "Next."]),
        ("Well... maybe. So sad... The end", ["Well... maybe.", "So sad...", "The end"]),
        ("Title 3\n\nText\ngoes on.Its end", ["Title 3", "Text\ngoes on.", "Its end"]),
        ("am 15. Oktober, z. B. am 2. Mai. Dann", ["am 15. Oktober, z. B. am 2. Mai.", "Dann"]),
        ("« Ça va ? » a demandé M. Ilvane ! Oui.", ["« Ça va ? » a demandé M. Ilvane !", "Oui."]),
        ("助手说：“你好吗？休息。”然后。版本1.1.6！好", ["助手说：“你好吗？休息。”然后。", "版本1.1.6！", "好"]),
        ("गया डॉ. Velkin के। अगला", ["गया डॉ. Velkin के।", "अगला"]),
        ("รุ่นใหม่ 2.1.6 ครั้ง ผู้ช่วย", ["รุ่นใหม่ 2.1.6 ครั้ง", "ผู้ช่วย"]),
        ("it ended. then more. and on", ["it ended.", "then more.", "and on"]),
        ("a friend warned me. The rest", ["a friend warned me.", "The rest"]),
        ("open ( bracket. Next one. \r\n\r\nlast", ["open ( bracket.", "Next one.", "last"]),
        ("  \n ", []),
        (None, []),
    ],
)
def test_units(text, units):
    ends = sentences.unit_ends(text)
    assert [text[a:b].strip() for a, b in zip([0, *ends], ends)] == units


@settings(max_examples=200, deadline=None)
@given(st.text("aB. !?\n\"'()“”。 ก", max_size=60))
def test_units_cover_all_text(text):
    ends = sentences.unit_ends(text)
    assert ends == sorted(set(ends)) and "".join(text[a:b] for a, b in zip([0, *ends], ends)).split() == text.split() if text.strip() else not ends


def test_split_rows(spark):
    df = spark.createDataFrame([(1, "Aa bb. Cc dd."), (2, None), (3, "")], "doc_id long, text string")
    assert [(r["doc_id"], r["unit"], r["end_char"], r["sentence"]) for r in sentences.split_sentences(df).orderBy("unit").collect()] == [(1, 0, 6, "Aa bb."), (1, 1, 13, "Cc dd.")]


def test_queries_against_sql(spark):
    queries = pytest.importorskip("wordloom.llm.queries")
    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("lcr_pass1b_canonical", "memory_lcr_candidates", "documents", "eval_items"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name, sql in queries.catalog.sql.items():
        a, b = queries.catalog.queries[name](spark, d).toPandas(), con.execute(sql).df()
        assert sorted(map(repr, a[sorted(a)].astype(str).values.tolist())) == sorted(map(repr, b[sorted(a)].astype(str).values.tolist()))
    for name, f in queries.catalog.queries.items():
        if name not in queries.catalog.sql:
            assert f(spark, d).where(F.lit(True)).count() >= 0
