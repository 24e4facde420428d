"""Residue among texts: what must be found whatever else stands in the table."""

from __future__ import annotations

from pointloom.llm.residue import boilerplate_lines, evidence, find_residue

REAL = "run {0} ended after {0} steps with a lower cost than the one before it on blobs"


def test_a_slot_that_recurs_beside_content_is_found(spark):
    rows = [(i, "a", REAL.format(i) + "\nConclusion: [object Object]\nOwner: {{ owner }}") for i in range(40)]
    rows += [(i, "b", REAL.format(i) + "\nPlease enable JavaScript to view this page.") for i in range(40, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text_of string, text string")
    assert sorted(r["doc_id"] for r in find_residue(docs, "doc_id", "text", "text_of").collect()) == list(range(40))


def test_what_is_recurrent_is_a_share_of_the_host(spark):
    docs = spark.createDataFrame([(i, "a", REAL.format(i) + ("\nback to overview" if i < 6 else "")) for i in range(3000)], "doc_id long, host string, text string")
    assert boilerplate_lines(docs, "text", "host").count() == 0
    assert boilerplate_lines(docs.where("doc_id < 300"), "text", "host").count() == 1


def test_repeated_filler_whatever_its_punctuation():
    assert evidence("content, content, content, content, content.") == "filler"


def test_furniture_is_subtracted_before_the_search(spark):
    for first in ("```", 'a line with one "open quote'):
        rows = [(i, "a", f"{first}\n" + (REAL.format(i) if i else "Error 404: page not found")) for i in range(31)]
        docs = spark.createDataFrame(rows, "doc_id long, host string, text string")
        assert [r["doc_id"] for r in find_residue(docs, "doc_id", "text", "host").collect()] == [0]


def test_hosts_that_do_not_part_words_have_furniture_too(spark):
    body = "实验{0}在第{0}步之后结束，成本低于之前的所有步骤，聚类结果稳定并且与标签一致，因此可以直接使用"
    rows = [(i, None, body.format(i) + "\nPlease enable JavaScript to view this page.") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, host string, text string")
    assert boilerplate_lines(docs, "text", "host").count() == 1
    assert find_residue(docs, "doc_id", "text", "host").count() == 0
    assert find_residue(docs, "doc_id", "text", "host", max_lines=0).count() == 0


def test_joined_hosts_give_what_broadcast_hosts_give(spark):
    rows = [(i, None if i % 3 == 0 else f"h{i % 3}", REAL.format(i) + "\nturn JavaScript on to see more" + ("\n{{ name }}" if i % 7 == 0 else "")) for i in range(300)]
    rows += [(1000, "alone", "403 Forbidden"), (1001, "alone", ""), (1002, "alone", None)]
    docs = spark.createDataFrame(rows, "doc_id long, host string, text string")
    one, other = (sorted(map(tuple, find_residue(docs, "doc_id", "text", "host", max_lines=m).collect())) for m in (10, 0))
    assert one == other and len(one) == 44


HELD_OUT = {
    True: [
        "We're sorry, but something went wrong.", "404 - File or directory not found.", "The requested URL was not found on this server.", "HTTP Status 500 – Internal Server Error",
        "Please turn JavaScript on and reload the page.", "Страница не найдена", "Strona nie została znaleziona", "Pagina niet gevonden", "페이지를 찾을 수 없습니다", "Whoops, looks like something broke.",
        "Sorry, we couldn't find that page.", "An unexpected error occurred. Try again later.", "Gone.", "Qualcosa è andato storto", "Algo deu errado", "Без javascript нельзя.\nВключите JavaScript",
    ],
    False: [
        r"The ratio \frac{a}{b} is bounded.", "Let {x} be a set and {y} another.", "Oops I forgot my keys at home and went back to fetch them.", "Conflict. Every good story needs one.", "Gone. The whole valley was gone.",
        "no no no no no no no!", "The run failed with `404 Not Found` in the log.", 'She wrote "something went wrong" in her notes.', "We found 404 runs, 12 of which had no cost.",
    ],
}


def test_wording_that_is_in_no_table():
    """At least nine in ten of texts that no test table holds are told rightly, on either side."""
    for wanted, texts in HELD_OUT.items():
        right = sum((evidence(t) is not None) == wanted for t in texts)
        assert right >= 0.9 * len(texts), [t for t in texts if (evidence(t) is not None) != wanted]
