"""Words, lines and sets that a weak hash would confuse: the word of Thue and Morse over two letters and its complement have
equal sums of letter codes times powers of any odd number modulo 2^64, whatever the number."""

from ledgerline.llm.ngram_join import ngram_components
from ledgerline.llm.repetition import measures


def twins(bits=11):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_and_lines_of_a_text():
    a, b = twins()
    m = measures([f"{a}\n{b}\n{a} {b}".encode(), f"{a}\n{b}\n{a}".encode(), (f"x {a} y\n" * 2 + f"x {b} y").encode()], 2)
    assert m["n_dup_lines"].tolist() == [0, 1, 1] and m["n_words"].tolist() == [4, 3, 9]
    assert m["n_repeat_words"].tolist() == [0, 0, 7]
    assert m["longest_repeat"].tolist() == [2, 1, 4]


def test_sets_of_two_texts(spark):
    a, b = twins()
    rows = [(1, a), (2, b), (3, f"{a} {b}"), (4, f"{b} {a}"), (5, a.upper()), (6, f"{a} " * 9), (7, f"{b} " * 9)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4), 5: (1, 1), 6: (1, 6), 7: (1, 7)}
