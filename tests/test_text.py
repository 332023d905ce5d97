"""Hand vectors for text normalisation (FIXTURES.md §3)."""

import pytest
from pyspark.sql import functions as F

from conftest import one
from precis.functions import text as T
from precis.functions import tokens as K


@pytest.mark.parametrize("src,want", [
    ("a   b", "a  b"), ('"""x"""', '"x"'), ('""""', '"'), ("x\n\ny", "x\ny")])
def test_clean_transcript(spark, src, want):
    assert one(spark, T.clean_transcript(F.col("s"), normalize=False), s=src) == want


def test_clean_transcript_nfkd(spark):
    assert one(spark, T.clean_transcript(F.col("s")), s="ﬁ ½") == "fi 1⁄2"


@pytest.mark.parametrize("src,want", [
    ("Head\n- Bullet one\n- Why?", "Head. Bullet one. Why?"), ("A.\n", "A.. .")])
def test_clean_summary(spark, src, want):
    assert one(spark, T.clean_summary(F.col("s")), s=src) == want


@pytest.mark.parametrize("src,want", [
    ("1. Intro", "Intro"), ("1: Foo. Bar", "Bar"), ("1: Foo", "Foo"), ("10. Ten", "10. Ten"),
    ("Sections: A", "s: A"), ("Topic", ""), ("I. Intro", "Intro"), ("ii. foo", "foo"),
    ("Heading: Foo", "Foo"), ("x", "x")])
def test_strip_line(spark, src, want):
    assert one(spark, T.strip_line(F.col("s")), s=src) == want


def test_clean_prediction(spark):
    src = "Heading: Foo\n\n- Bar baz.\n* Qux: \nSummary: done"
    assert one(spark, T.clean_prediction(F.col("s")), s=src) == "Foo\nBar baz\nQux"
    assert one(spark, T.clean_prediction(F.col("s")), s="AI\nLonger line") == "Longer line"


def test_strip_suffix_and_notes(spark):
    assert one(spark, T.strip_suffix(F.col("s")), s="Title: ") == "Title"
    assert one(spark, T.strip_suffix(F.col("s")), s="Title:") == "Title"
    assert one(spark, T.is_note_line(F.col("s")), s="Overall Summary: x") is True
    assert one(spark, T.is_note_line(F.col("s")), s="Notable") is False


def test_remove_empty_lines(spark):
    assert one(spark, T.remove_empty_lines(F.col("s")), s="a \n \n\tb\n\nc") == "a\nb\nc"


def test_sentence_pairs(spark):
    assert one(spark, T.reference_sentences(F.col("s")), s="A b. C d? E f.") == ["A b", "C d", "E f"]
    assert one(spark, T.candidate_sentences(F.col("s")), s="x\ny\nz") == ["x", "y", "z"]


def test_short_label_and_topics(spark):
    assert one(spark, T.short_label(F.col("s")), s="a" * 25) == "a" * 20 + "..."
    assert one(spark, T.short_label(F.col("s")), s="short") == "short"
    assert one(spark, T.topic_token(F.col("s")), s="  Machine Learning ") == "machine_learning"
    assert one(spark, T.topic_string(F.col("s")), s="a,b") == "a, b."


def test_rouge_preprocess(spark):
    got = one(spark, K.rouge_preprocess(F.col("s")), s="The cat sat on the mat. A dog, barked loudly!")
    # last token of each sentence popped, stop words dropped, commas removed
    assert got == "cat sat mat\ndog barked loudly"


def test_induction_cleanup(spark):
    assert one(spark, T.induction_cleanup(F.col("s")), s="assistant: do X\n----------\nY") == "do XY"


def test_nfkd_hands_on_ascii_pieces_and_nulls():
    import unicodedata

    import pyarrow as pa

    from precis.functions import text as T
    texts = ["plain"] * 100 + ["ﬁ é", None, "Å"] + ["x"] * 70
    want = [None if t is None else unicodedata.normalize("NFKD", t) for t in texts]
    assert T._nfkd(pa.array(texts)).to_pylist() == want and len(T._nfkd(pa.array([], pa.string()))) == 0
