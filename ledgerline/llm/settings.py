"""Production parameters that the queries and the corpus pipeline share."""

import public_tokenizers

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

#: Target weights: the largest source gives way to nineteen others; whatever has no name here shares `REST`.
WEIGHTS = {"src0": 0.2} | {f"src{i}": 0.04 for i in range(1, 20)}
REST, EPOCHS, SEED = 0.04, 1.0, 17
