import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import no_lines, odd_lines, ordered
from tidemark.llm.bpe import PairRankEncoder, encode_transaction_lines

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tool = Tokenizer.from_file(PATH)
    tool.no_truncation()
    tool.no_padding()
    return tool


def test_random_texts_are_encoded_and_decoded_as_by_the_library(library):
    own = PairRankEncoder(PATH)
    rng = random.Random(9)
    alphabet = "aab  \n\t\r\x0b\x1c\x85 ​ 'stremllvd09²éß漢\U0001f600́%$-_|<>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += ["", "a<|endoftext|>b", "<|endoftext|><|endoftext|> x", "a" * 3000, "\x00", " " * 50 + "x", "can't WE'LL"]
    ids, counts = own.encode(texts)
    decoded = own.decode(ids, counts)
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    at = 0
    for n, want, back in zip(counts, wanted, decoded):
        assert ids[at : at + n].tolist() == want
        assert back == library.decode(want, skip_special_tokens=False)
        at += n


def test_forgotten_pre_tokens_are_encoded_again(library, monkeypatch):
    monkeypatch.setattr("tidemark.llm.bpe._CACHE_ENTRIES", 3)
    own = PairRankEncoder(PATH)
    for text in ("one two three four five", "six seven", "one two"):
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_odd_lines(spark, library):
    lines = odd_lines(spark)
    found = encode_transaction_lines(lines, PATH).collect()
    wanted = [
        (r["line_number"], library.encode(r["line"] or "", add_special_tokens=False).ids, r["line"] or "")
        for r in lines.collect()
    ]
    assert ordered((r[0], r[2], str(r[1])) for r in found) == ordered((n, t, str(i)) for n, i, t in wanted)
    assert encode_transaction_lines(no_lines(spark), PATH).count() == 0
