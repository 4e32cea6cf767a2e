import random

import public_tokenizers
import sentencepiece

from tests.llm.helpers import no_lines, odd_lines, ordered
from tidemark.llm.token_counts import count_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_are_those_of_the_library(spark):
    rng = random.Random(1)
    alphabet = "aab   \n\t\x00\x01\x02\x85  'stremllvd09é漢\U0001f600%$▁<s></s>"
    extra = [(100 + i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(3000)]
    extra += [(5000 + i, t) for i, t in enumerate([" ", "  ", "▁", "a ", "a" * 5000])]
    lines = odd_lines(spark, extra)
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    wanted = []
    for row in lines.collect():
        text = row["line"] or ""
        n = len(model.encode(text))
        wanted.append((row["line_number"], len(text.encode()), n, n > 100))
    assert ordered(count_tokens(lines, PATH, limit=100, word_buckets=7).collect()) == ordered(wanted)


def test_no_lines(spark):
    assert count_tokens(no_lines(spark), PATH).count() == 0
