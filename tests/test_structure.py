"""Element trees, numbering, references and edges on a small law written out by hand."""

import pytest
from pyspark.sql import functions as F

from evigrain.operators import structure

LAW = """CHAPTER IV Rights

Section 1. Definitions
(1) "personal data" means any data under section 26(1).

Section 26A Transfer
(1) Personal data shall not leave unless section 1(1) applies.
  wrapped line
(2) Subsection (1) does not apply to a person under section 99.
(a) a child

Notwithstanding section 26A, the Minister may exempt.

Provided that a fee is paid."""


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "heading, expected",
    [("Section 26A — Transfer", "s. 26A"), ("SEC 5(1)(a) x", "s. 5(1)(a)"), ("Art. 12(1)", "art. 12(1)"), ("CHAPTER iv — X", "ch. IV"), ("Preamble", None), ("Section 3(A)", "s. 3"), (None, None)],
)
def test_numbering(spark, heading, expected):
    assert one(spark, structure.numbering(F.col("h")), h=heading) == expected


def test_references_in_order_and_once(spark):
    text = "Article 5 and section 26(1)(a), s. 26(1)(a), sub-section (2)(b), Paragraph (c), section 7(x)(1)"
    assert one(spark, structure.references(F.col("t")), t=text) == ["s. 26(1)(a)", "s. 7(x)", "art. 5", "(subsection (2)(b))", "(paragraph c)"]
    assert one(spark, structure.references(F.col("t")), t="none") == []


def test_tree_and_edges(spark):
    docs = spark.createDataFrame([(1, LAW), (2, LAW), (3, None), (4, "  \n\n "), (5, "\n(1) lone item\n")], "doc_id long, text string")
    tree = structure.element_tree(docs)
    rows = tree.where("doc_id = 1").orderBy("seq").collect()
    got = [(r.element_id, r.parent_id, r.element_type, r.numbering) for r in rows]
    assert got == [
        ("1_chapter_0", None, "heading", "ch. IV"),
        ("1_s1", "1_chapter_0", "section", "s. 1"),
        ("1_definition_2", "1_s1", "definition", "s. 1(1)"),
        ("1_s26A", "1_chapter_0", "section", "s. 26A"),
        ("1_list_item_4", "1_s26A", "list_item", "s. 26A(1)"),
        ("1_list_item_5", "1_s26A", "list_item", "s. 26A(2)"),
        ("1_list_item_6", "1_s26A", "list_item", "s. 26A(2)(a)"),
        ("1_paragraph_7", "1_s26A", "paragraph", None),
        ("1_paragraph_8", "1_s26A", "paragraph", None),
    ]
    assert all(LAW[r.char_start : r.char_end].split() == r.text.split() for r in rows)
    lone = tree.where("doc_id > 2").collect()
    assert [(r.doc_id, r.parent_id, r.element_type, r.numbering) for r in lone] == [(5, None, "list_item", None)]
    found = structure.edges(tree)
    assert {(r.from_element, r.to_element, r.edge_type) for r in found.where("doc_id = 1").collect()} == {
        ("1_list_item_4", "1_definition_2", "cross_reference"),
        ("1_list_item_5", "1_list_item_4", "cross_reference"),
        ("1_paragraph_7", "1_s26A", "cross_reference"),
        ("1_paragraph_7", "1_s26A", "notwithstanding"),
        ("1_paragraph_8", "1_s26A", "proviso"),
        ("1_list_item_5", "1_s26A", "proviso"),
        ("1_definition_2", "1_list_item_4", "defines"),
    }
    assert found.where("doc_id = 2").count() == 7 and found.where("split(from_element, '_')[0] <> split(to_element, '_')[0]").count() == 0
