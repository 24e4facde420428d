"""Tokens, leaks and residue."""

from __future__ import annotations

import base64
import random

import pytest

from pointloom.llm.leaks import Index, find_leaks, remove_leaks
from pointloom.llm.residue import boilerplate_lines, evidence, find_residue
from pointloom.llm.texts import word_spans, words
from pointloom.llm.tokens import PATTERN, VOCABULARY, Encoder, decode_ids, encode_texts, load_vocabulary

TEXTS = [
    None, "", " ", "Hello world", "  two  spaces\n\n\tand tabs ", "don't we'll they've I'm it's 'quoted'", "naïve café Überschrift", "日本語のテキスト。標本数500", "😀👩‍👩‍👧 mixed 🇩🇪", "<|endoftext|> is ordinary",
    "a" * 5000, "x1y2" * 500, "​‍﻿", "١٢٣ ⅷ ²", "line\r\nbreak\x0b\x0c\x1c\x85end", "\x00\x01", "ﬁ ﬂ ａｂｃ", "=" * 300, "é combining", "tab\tsep\tvalues\n" * 50,
]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_reference_encoder(spark, reference):
    rng = random.Random(0)
    alphabet = "abcXYZ 0189 \n\t'.,-äöüßéñ日本語ひら😀‍ "
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    out = encode_texts(df, "doc_id", "text")
    got = {r["doc_id"]: list(r["ids"]) for r in out.collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    back = {r["doc_id"]: r["text"] for r in decode_ids(out, "doc_id").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_merges_reach_every_entry_and_equal_a_naive_merge():
    e = Encoder(load_vocabulary())
    rng = random.Random(1)
    entries = rng.sample(sorted(e.ranks), 3000)
    assert all(e.merged(b) == [e.ranks[b]] for b in entries)
    for _ in range(200):
        piece = bytes(rng.choice(b"abcdeth \xc3\xa9") for _ in range(rng.randrange(1, 40)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((e.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert e.merged(piece) == [e.ranks[p] for p in parts]


def test_an_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert encode_texts(spark.createDataFrame([], schema), "doc_id", "text").count() == 0
    assert encode_texts(spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], schema), "doc_id", "text").count() == 3


ITEM = "Which of restart number 277 or the jittered graph lets the finding harness lift a shell against the prior"
DISGUISES = [
    ITEM, ITEM.upper(), ITEM.replace(" ", "&nbsp;"), ITEM.replace(" ", "  \t\n"), ITEM.replace("fi", "ﬁ"), ITEM.replace("of", "<b>o</b>f"), "> " + ITEM.replace("the", "\n> the"), ITEM.replace("graph", "**graph**,"),
    "".join(c + ("​" if c == "a" else "­" if c == "e" else "") for c in ITEM), "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in ITEM), "before it. " + ITEM + " after it", "[Which of restart](http://x.y) number 277 or the jittered graph lets the finding harness",
    "_".join(ITEM.split()), " ".join(ITEM.split()[3:13]),
]
HONEST = [None, "", "short", " ".join(ITEM.split()[3:12]), ITEM.replace("the", "roughly the"), " ".join(reversed(ITEM.split())), "word " * 500]


def test_leaks_in_disguise(spark):
    items = spark.createDataFrame([(1, ITEM), (2, ITEM + " and more"), (3, None), (4, "too short"), (5, "")], "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(DISGUISES + HONEST)], "doc_id long, text string, item_id string")
    docs = docs.drop("item_id")
    for most in (10, 64_000_000):
        got = sorted((r["doc_id"], r["item_id"]) for r in find_leaks(docs, "doc_id", "text", items, "item_id", "text", max_bytes=most).collect())
        assert got == [(i, k) for i in range(len(DISGUISES)) for k in (1, 2)]
    clean = remove_leaks(docs, "doc_id", "text", items, "item_id", "text")
    assert find_leaks(clean, "doc_id", "text", items, "item_id", "text").count() == 0
    kept = {r["doc_id"]: (r["text"], r["n_removed"]) for r in clean.collect()}
    assert all(kept[len(DISGUISES) + i] == (t, 0) for i, t in enumerate(HONEST))
    assert kept[10][0].startswith("before it. ") and kept[10][0].endswith(" after it")


def test_cuts_do_not_depend_on_the_number_of_passes(spark):
    """One document, three overlapping items: however many passes find them, one cut takes all."""
    said = [f"word{i}x" for i in range(60)]
    items = [(1, " ".join(said[5:20])), (2, " ".join(said[10:25])), (3, " ".join(said[18:40])), (4, None)]
    docs = spark.createDataFrame([(1, " ".join(said)), (1, " ".join(said[:8])), (2, None), (3, "")], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    results = [sorted(map(str, remove_leaks(docs, "doc_id", "text", table, "item_id", "text", max_bytes=m).collect())) for m in (1 << 30, 3000, 1)]
    assert results[0] == results[1] == results[2]
    assert any("word4x" in r and "word40x" in r and "word39x" not in r and "n_removed=1" in r for r in results[0])


def test_a_text_without_exact_places_keeps_its_other_words():
    from pointloom.llm.leaks import _without

    assert _without("&amp;lt;b&amp;gt; x", [[0, 0]]) != ""


def test_index_is_of_bounded_bytes():
    from pointloom.llm.leaks import BYTES_A_BYTE

    rng = random.Random(3)
    items = [(i, " ".join(f"{rng.choice('abcdef')}{rng.randrange(3000)}" for _ in range(300))) for i in range(300)]
    text = sum(len(t) for _, t in items)
    assert Index(items).size < 2 * BYTES_A_BYTE * text


def test_leaks_against_brute_force():
    rng = random.Random(0)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(30))) for i in range(20)]
    index = Index(items, 4)
    grams: dict = {}
    for i, t in items:
        w = t.split()
        for k in range(len(w) - 3):
            grams.setdefault(tuple(w[k : k + 4]), set()).add(i)
    for _ in range(100):
        doc = [rng.choice([*vocabulary, "zz", "yy"]) for _ in range(60)]
        want = {(k, frozenset(grams[g])) for k in range(len(doc) - 3) if (g := tuple(doc[k : k + 4])) in grams}
        assert {(k, frozenset(v)) for k, v in index.hits(doc)} == want


def test_spans_give_the_same_words():
    for t in [t for t in [*DISGUISES, *TEXTS] if t]:
        spans = word_spans(t)
        assert not spans or [w for w, _, _ in spans] == words(t)
    assert all(word_spans(t) for t in DISGUISES)


RESIDUE = [
    "Summary: {{ owner }}", "Dear %(name)s, your run is complete.", "Reviewed by $TITLE$ on [INSERT DATE HERE].", "Owner: [Reviewer]", "Next step: {% block x %}{% endblock %}", "k = ${K_TARGET}", "Date: __DATE__", "found <seed goes here> twice", "Conclusion: (summary to be filled in)",
    "a score of {ari:.3f} here", "value [object Object]", "We saw XXXX last week.", "Next step: _____", "<<METRIC>>", "@@seed@@ again", "#{dataset}", "404 Not Found", "HTTP/1.1 503 Service Unavailable", "<html><head><title>502 Bad Gateway</title></head><body><h1>Bad Gateway</h1></body></html>",
    "Some text first.\n{\"error\": {\"code\": 500, \"message\": \"internal server error\"}}", "Error 404: the address may have moved.", "ERREUR 404 : la page demandée est introuvable.", "Oops! Something went wrong on our side.", "Access denied. Your address has been blocked.", "Your session has expired.",
    "upstream connect error or reset before headers. reset reason: timeout", "You have reached the limit of requests for this hour.", "We are down for maintenance. Back shortly.", "Please enable JavaScript to view this page.", "Good text stands here. This site requires JavaScript.",
    "<noscript>Scripts are blocked. Allow them for this site to go on.</noscript>", "Diese Anwendung benÃ¶tigt Skripte und Cookies.", "このページを表示するにはJavaScriptを有効にしてください。", "Checking your browser before you go on...", "Lorem ipsum dolor sit amet", "Ip vel maosing bus te bus lo sum sec sitvel el damitlor ing",
    "sample text sample text sample text sample text sample text", "gljgskdjj fkljh ksgl sfdfg jjhs faka shgl", "This is placeholder text. Replace it with your own.", "TODO\ncoming soon\nn/a", "n/a", "Hier steht später die Beschreibung.", "Votre description apparaîtra ici.",
]
CONTENT = [
    "", "   ", "Complete prose about k-means and its seeds.", "The TODO list of round 3 is done: ties are averaged.", "In the config, `${K_TARGET}` is expanded by the runner.", "We searched the notes for \"[INSERT DATE HERE]\" and found none.", "The mirror says \"503 Service Unavailable\" when it is overloaded.",
    "The sentinel holds the body `{\"code\": 404, \"message\": \"not found\"}`; we kept it.", "Error 500 in the title is a sample size: at n=500 the error is small.", "The dashboard is plain JavaScript and needs no server.", "The cluster set is {x in S : d(x, c) < 0.5} as before.", "One card still said \"lorem ipsum\" in its notes.",
    "A notice like \"<noscript>Enable JavaScript.</noscript>\" means that the crawl met a wall.", "```\ntitle: \"Run {run_id} on {dataset}\"\nfill: true\n```\nWith this header it works.", "Use f\"{name:.3f}\" in the formatter.", "algo\tk\tscore\nkmeans\t3\tn/a", "[12:00:01] kmeans step=1 cost=2.0 ok", "See [the notes](http://a.b) and [1].",
    "Access to the traces was denied to the job until its role was fixed.", "Three of the fetches ended in a gateway timeout.", "[Note] all is well. [INFO] still well.", "It costs $5 and 7% of $12.", "Dunder __init__.py is code? No: see `__init__`.",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue_is_found(text):
    assert evidence(text), text
    assert text == "n/a" or evidence("Menu\n" + text + "\n© notes"), text


@pytest.mark.parametrize("text", CONTENT)
def test_content_is_left(text):
    assert evidence(text) is None, text


def test_boilerplate_is_subtracted_but_not_a_host_of_error_pages(spark):
    long = "A whole sentence of real content with at least twelve words in it, number"
    good = [(i, f"{long} {i}.\nPlease enable JavaScript to vote.", "good") for i in range(40)]
    bad = [(100 + i, "Please enable JavaScript to vote.", "bad") for i in range(40)]
    odd = [(200, None, "good"), (201, "", None), (202, "Summary: {{ x }}\nPlease enable JavaScript to vote.", "good"), (203, "TODO", None)]
    docs = spark.createDataFrame([(*r, "own") for r in good + bad + odd], "doc_id long, text string, source string, evidence string").repartition(4)
    assert [(r["host"]) for r in boilerplate_lines(docs, "text", "source").collect()] == ["good"]
    got = {r["doc_id"]: r["evidence"] for r in find_residue(docs.drop("evidence"), "doc_id", "text", "source").collect()}
    assert got == {**{100 + i: "script" for i in range(40)}, 202: "slot", 203: "empty"}


def test_residue_of_nothing_and_of_a_very_long_text(spark):
    schema = "doc_id long, text string, source string"
    assert find_residue(spark.createDataFrame([], schema), "doc_id", "text", "source").count() == 0
    plain = " ".join(f"Plain words about cluster {i}." for i in range(20_000))
    rows = [(1, plain, "a"), (2, plain + "\nOwner: {{ owner }}", "a"), (2, "{{ owner }}", "a")]
    assert sorted(r["doc_id"] for r in find_residue(spark.createDataFrame(rows, schema), "doc_id", "text", "source").collect()) == [2, 2]
