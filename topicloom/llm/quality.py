"""Line-first cleaning (operator 2).

Every line is judged on its own: punctuation, navigation, boilerplate, symbol and shouting rules and repetition of an earlier line.  Failing
lines are removed, and a document is rejected when too large a part of its words goes with them.  Each document is one row of
one task; nothing is shuffled, so hot sources and copies do not matter.

Defined cases: a null text is the empty text, which has no words and is rejected; empty lines carry no words and are kept; tables
without rows give no rows; repeated rows are judged one by one; other columns stay (``clean_documents``) or are ignored (``line_quality``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import arrow_rows

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
# Terminal punctuation of the scripts in use; closing quotes and brackets may follow.
TERMINAL = ".!?…:;。！？｡؟։।"
CLOSING = "\"'”’»«)]}›"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, lines_removed long, words_removed long, clean_text string"
)
_BOILERPLATE = re.compile(
    r"all rights reserved|licensed under|released under the|copyright|©|terms of (use|service)|privacy policy|"
    r"cookie (policy|settings)|accept (all )?cookies|enable javascript|subscribe to our|sign up for|log ?in to|lorem ipsum", re.I)
_NAVIGATION = re.compile(r"[|›»>/•·]")
_RUNS = re.compile(r"!!+|\?\?+")


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the verdict; shares are of words or characters of the line."""

    short_line: int = 25          # a line of at least so many words needs no terminal punctuation
    navigation_share: float = 0.1  # separators standing alone, to words
    symbol_share: float = 0.05    # symbols to characters of words
    upper_share: float = 0.6      # capitals to letters
    boilerplate_words: int = 30   # longer lines are prose that mentions the phrase
    max_lost_share: float = 0.4   # of the words of the document


def line_fails(line: str, words: list[str], rules: LineRules) -> bool:
    n = len(words)
    if n <= rules.boilerplate_words and _BOILERPLATE.search(line):
        return True
    separators = sum(1 for w in words if len(w) == 1 and _NAVIGATION.match(w))
    if separators >= 2 and separators > rules.navigation_share * n:
        return True
    raw = line.encode("utf-8", "surrogatepass")
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    chars = sum(map(len, words))
    if symbols >= 2 and symbols > rules.symbol_share * chars:
        return True
    if line.isupper() or _RUNS.search(line):
        letters = sum(c.isalpha() for c in line)
        upper = sum(c.isupper() for c in line)
        if letters >= 12 and upper > rules.upper_share * letters:
            return True
        if n >= 3 and len(_RUNS.findall(line)) > 0.3 * n:
            return True
    if n < rules.short_line and line.rstrip(" \t\r\x0b\x0c" + CLOSING)[-1:] not in TERMINAL:
        return True
    return False


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of ``size`` words that occur twice or more in the text, the first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(size))))
    distinct = set(windows)
    if len(distinct) == len(windows):
        return 0
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    count, covered = 0, 0  # ``covered``: end of the words counted so far
    for i, w in enumerate(windows):
        if w in twice:
            count += i + size - max(i, covered)
            covered = i + size
    return count


def judge(text: str | None, rules: LineRules) -> tuple:
    """The values of one document, in the order of the schema after the id."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n_words = len(words)
    white = len(raw) - len(raw.translate(None, SPACE))
    word_chars = len(text) - white
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    n_repeat = repeated_words(words)
    n_dup, lost, removed, seen, kept_lines = 0, 0, 0, set(), []
    for line in text.split("\n"):
        line_words = line.replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
        line_words = [w for w in line_words if w]
        if not line_words:
            kept_lines.append(line)
            continue
        again = line in seen
        seen.add(line)
        n_dup += again
        if again or line_fails(line, line_words, rules):
            removed += 1
            lost += len(line_words)
        else:
            kept_lines.append(line)
    base_failed = n_words < 50 or 100 * n_repeat > 50 * n_words
    kept = not base_failed and lost <= rules.max_lost_share * n_words
    return n_words, word_chars, n_symbols, n_dup, n_repeat, base_failed, kept, removed, lost, "\n".join(kept_lines)


def line_quality(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts, the verdict and the text without the failing lines."""

    def rows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [judge(t.as_py(), rules) for t in batch.column(1)]
        columns = [batch.column(0), *(pa.array(c) for c in zip(*values))]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return arrow_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), rows_of, SCHEMA)


def clean_documents(docs: DataFrame, rules: LineRules = LineRules(), text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that are kept, all their columns, the text without its failing lines."""
    place = docs.columns.index(text_col)

    def rows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [judge(t.as_py(), rules) for t in batch.column(place)]
        texts = pa.array([v[9] for v in values], pa.string())
        columns = [texts if i == place else batch.column(i) for i in range(batch.num_columns)]
        keep = pa.array([v[6] for v in values], pa.bool_())
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(keep)

    return arrow_rows(docs, rows_of, docs.schema)
