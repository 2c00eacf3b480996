"""License scan: exact phrases, and a fuzzy search for short notices."""

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import chunks, mapped, texts

#: Phrases of the exact scan and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


class Notice(NamedTuple):
    """A short notice in lower-case words; `keys` must stand unchanged in the match, `errors` edits are allowed."""

    label: str
    text: str
    errors: int
    keys: tuple[str, ...] = ()


NOTICES = (
    Notice("mit", "under the mit license", 2, ("mit",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 7),
    Notice("apache-2", "apache license version 2", 3, ("apache", "2")),
    Notice("gpl-2", "gnu general public license version 2", 4, ("general", "2")),
    Notice("gpl-3", "gnu general public license version 3", 4, ("general", "3")),
    Notice("lgpl", "gnu lesser general public license", 4, ("lesser",)),
    Notice("agpl", "gnu affero general public license", 4, ("affero",)),
    Notice("mpl-2", "mozilla public license version 2 0", 4, ("mozilla", "2")),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", 8),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 7),
    Notice("cc-by", "creative commons attribution 4 0 international", 4, ("attribution",)),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 4, ("attribution", "commons")),
    Notice("public-domain", "this is free and unencumbered software released into the public domain", 7),
)

SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, spans array<struct<label string, first_word int, n_words int, edits int, text string>>")

#: Lower-cases A-Z, keeps digits, lower-case letters and bytes of other scripts, and blanks the rest.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class WordNumbers:
    """Number of the word that starts at a place of a padded text; the blanks are looked for once, at the first question."""

    def __init__(self, padded: str):
        self.padded, self.blanks = padded, None

    def __call__(self, place: int) -> int:
        if self.blanks is None:
            self.blanks = np.flatnonzero(np.frombuffer(self.padded.encode("latin-1"), np.uint8) == 32)
        return int(np.searchsorted(self.blanks, place)) - 1


class Scanner:
    """Seeds of all notices in one automaton, and a bounded-error pattern for each notice.

    A notice with k edits is cut into k + 1 pieces; at least one of them is untouched by k edits, so the
    places of the pieces give all candidates.  Bytes of the text are handled as one character each.
    """

    def __init__(self, notices: Sequence[Notice] = NOTICES):
        self.notices = [n._replace(text=n.text.encode().decode("latin-1")) for n in notices]
        self.seeds = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(self.notices):
            cuts = [len(n.text) * k // (n.errors + 1) for k in range(n.errors + 2)]
            for a, b in zip(cuts, cuts[1:]):
                found.setdefault(n.text[a:b], []).append((i, a))
        for seed, uses in found.items():
            self.seeds.add_word(seed, (len(seed), uses))
        self.seeds.make_automaton()
        # BESTMATCH would look through the whole window for each match; ENHANCEMATCH improves the fit of the match found
        self.patterns = [regex.compile(f"(?e)(?:{regex.escape(n.text)}){{e<={n.errors}}}") for n in self.notices]
        self.exact = [(regex.compile(f"(?<= ){p}(?= )"), f" {p} ", label) for p, label in PHRASES.items()]

    def base(self, padded: str) -> list[tuple[int, str]]:
        """Word number and label of every place of an exact phrase."""
        number = WordNumbers(padded)
        return [(number(m.start()), label) for pattern, plain, label in self.exact if plain in padded for m in pattern.finditer(padded)]

    def fuzzy(self, padded: str) -> list[tuple[str, int, int, int, str]]:
        """Label, first word, number of words, edits and text of the notices found, at word bounds."""
        number, candidates = WordNumbers(padded), {}
        for end, (size, uses) in self.seeds.iter(padded):
            for i, at in uses:
                candidates.setdefault(i, []).append(end + 1 - size - at)
        out = set()
        for i, places in candidates.items():
            n, pattern = self.notices[i], self.patterns[i]
            slack, places = n.errors, sorted(places)
            start = 0
            for k in range(1, len(places) + 1):
                if k < len(places) and places[k] - places[k - 1] <= 2 * slack:
                    continue  # one occurrence, or several close together
                low, high = max(0, places[start] - slack), places[k - 1] + len(n.text) + slack
                start = k
                for m in pattern.finditer(padded, low, min(high, len(padded)), overlapped=False):
                    a, b = m.start(), m.end()
                    while a < b and padded[a] == " ":
                        a += 1
                    while b > a and padded[b - 1] == " ":
                        b -= 1
                    a, b = padded.rfind(" ", 0, a) + 1, padded.find(" ", b)
                    span = padded[a:b]
                    words = span.split(" ")
                    if all(key in words for key in n.keys):
                        out.add((n.label, number(a), len(words), sum(m.fuzzy_counts), span, len(n.text)))
        return sorted(out)

    def scan(self, text: bytes) -> dict:
        words = text.translate(TO_WORDS).split()
        padded = f" {b' '.join(words).decode('latin-1')} "
        base, found = self.base(padded), self.fuzzy(padded)
        at = [w for w, _ in base]
        exact = {label for _, label in base}
        return {
            "n_words": len(words), "n_base": len(base), "first_word": min(at, default=None), "last_word": max(at, default=None),
            "base_labels": ",".join(sorted(exact)), "labels": ",".join(sorted(exact | {f[0] for f in found})),
            "score": 1.0 if base else max((1 - edits / (size + 1) for *_, edits, _, size in found), default=0.0),
            "spans": [{"label": f[0], "first_word": f[1], "n_words": f[2], "edits": f[3], "text": f[4].encode("latin-1").decode("utf-8", "replace")}
                      for f in found],
        }


def scan_licenses(docs: DataFrame, notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """Exact phrases and fuzzy notices of every whole text.

    Reads `doc_id` and `text`; other columns are ignored.  Returns the columns of SCHEMA: n_base, first_word, last_word
    and base_labels belong to the exact phrases, `labels` to both searches, `spans` to the fuzzy one; score is 1
    for an exact phrase, else 1 - edits / (length + 1) of the best notice, 0 without one.  Null and empty texts
    have no words, empty labels and score 0; repeated rows give repeated results; an empty table gives an
    empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, schema = Scanner(notices), None
        kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(pa.struct([
            ("label", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("edits", pa.int32()), ("text", pa.string())]))}
        schema = [(c, kinds.get(c, pa.int64())) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")]
        for batch in chunks(batches):
            rows = [scanner.scan(t) for t in texts(batch)]
            columns = {"doc_id": batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())}
            yield pa.RecordBatch.from_pydict(columns | {c: pa.array([r[c] for r in rows], kind) for c, kind in schema})

    return mapped(docs.select("doc_id", "text"), run, SCHEMA)
