"""Names that differ in case alone, memory of remembered chunks, blocks that a paragraph's own names condemn."""

import public_tokenizers
import pytest
import tiktoken  # noqa: F401

from quillmesh.llm import bpe, decontaminate, extract, pii, toxicity

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize("names", [("_MASKED", "_HIT", "_TOXIC"), ("_masked", "_Hit", "_toxic"), ("_MASKED_", "_hit", "_Toxic")])
def test_stages_keep_columns_whose_names_differ_in_case(spark, names):
    ddl = f"doc_id long, text string, {', '.join(f'{n} string' for n in names)}, Label int"
    docs = spark.createDataFrame([(1, "write to a.b@c.de today", "x", "y", "z", 1), (2, None, None, None, None, None)], ddl)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for got in (pii.redacted(docs), decontaminate.clean(docs, bench), toxicity.accepted(docs, toxicity.train(docs, labels))):
        assert got.columns == docs.columns and got.count() == 2
        assert {r[names[0]] for r in got.collect()} == {"x", None}


def test_what_an_encoder_remembers_is_bounded_in_bytes():
    encoder = bpe.Encoder(PATH, public_tokenizers.PATTERN, memo=1 << 16)
    plain = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    for k in range(40):
        texts = [chr(0x4E00 + (k * 31 + j) % 9000) * 200 + str(k * j) for j in range(20)]
        assert encoder.encode(texts) == plain.encode(texts)
        assert encoder.held <= 1 << 16
        assert encoder.held or not encoder.memo


LONG = "The committee met on Tuesday to discuss the plan for the harbour and the new bridge across the bay, and decided to go on."


@pytest.mark.parametrize("junk", ['<p class="advert">Buy our shoes now at half the price, today only.', '<p role="alert">This site uses cookies to give you the best experience.</p>', '<p class="comment">I think so too, thank you for writing this.</p>', "<p id=newsletter-3>Send me the news of every week.</p>"])
def test_paragraphs_carry_their_names(junk):
    page = f"<article><h1>Title</h1><p>{LONG}{junk}<p class=lead>{LONG}</article>"
    assert extract.main_text(page) == f"Title\n{LONG}\n{LONG}"


def test_comments_in_paragraphs_after_an_article():
    assert extract.main_text(f'<article><p>{LONG}</p></article><p class="comment">{LONG}</p>') == LONG


def test_an_advert_within_a_line_goes_and_the_line_stays():
    page = f'<article><p>{LONG} <span class="ad">Buy <span>this</span> now!</span> And more.</p><p>{LONG}<b class="sponsored">never closed</p><p>{LONG}</p></article>'
    assert extract.main_text(page) == f"{LONG} And more.\n{LONG}\n{LONG}"
    assert extract.main_text(f'<article><p>{LONG} <em class="term">kept</em></p></article>') == f"{LONG} kept"
