"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are long runs of key-like characters, values assigned to names that speak of secrets,
with or without quotes, passwords in URLs, tokens of three dotted parts, and private-key blocks. A random forest, trained on the labelled findings of ``secret_training``,
scores each from its length, its character classes and the transitions between them, the share of
it that dictionary words cover, its path, and the words around it. The forest's trees lie
flattened in arrays, which numpy traverses for all candidates of a batch at once.

The dictionary is a fixed list and the words of the document itself. Texts are scanned whole, and
every candidate is scored. Null and empty texts have none. A null path is the empty path. Rows
are mapped one to one; ids may be null or repeat; only the named columns are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm.common import arrow_map, table
from cellgrid.llm.secret_training import WORDS, labelled_findings

LEAST_SCORE = 0.5
TREES = 60
DEPTH = 12
LEAST_ROWS = 3
AROUND = 48

RUN = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}={0,2}")
ASSIGNED = re.compile(
    r"(?i)(?:passw(?:or)?d|pwd|pw(?<![a-z]pw)|passphrase|secret|token|api[_-]?key|(?:access|private|secret|signing|auth)[_-]?key|credentials?|bearer)[\"']?\s{0,4}[=:]\s{0,4}"
    # A bare value goes up to white space, a quote, the next parameter or tag; marks that end a sentence or a list are not its last.
    r"(?:[\"']([^\"'\s]{6,})[\"']|((?:(?!&\w+=|</)[^\"'\s]){7,}(?!&\w+=|</)[^\"'\s.,;)\]}>]))"
)
#: Every name that ``ASSIGNED`` takes holds one of these in lower case (or the long s, which it takes for an s); texts without any are not searched for it.
STEMS = ("passw", "pw", "passphrase", "secret", "token", "key", "credential", "bearer", "\u017f")
URL = re.compile(r"://[^\s/:@\"'<>]{0,256}:([^\s/\"'<>]+)@")
#: Three runs joined by dots, the first two encoded objects: one token.
JWT = re.compile(r"(?<![A-Za-z0-9_\-])eyJ[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]{6,}(?:\.[A-Za-z0-9_\-]+)?")
#: A value that is an expression of a program, which names a secret and is none.
CODE = re.compile(r"[\[(]|\$\{|\{\{|^<|^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+$")
BLOCK = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]*-----END [A-Z ]{0,40}PRIVATE KEY-----")
PLAIN = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]+|[+/_\-=]+")
LETTERS = re.compile(r"[A-Za-z]{3,}")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_\-]*")

# Words that speak for or against a secret, and of paths.
SPEAKS_FOR = frozenset("token secret password passwd pwd key apikey auth credential credentials bearer authorization private signing access login".split())
SPEAKS_AGAINST = frozenset("id uuid guid commit sha md5 sha1 sha256 checksum digest etag hash integrity revision version build ref parent fingerprint cache class name label slug url href path card account phone number order image data base64".split())
PLACEHOLDER = ("example", "your", "here", "xxxx", "change", "replace", "insert", "dummy", "sample", "test", "0000", "1234567", "placeholder")
PATH_SAFE = ("test", "fixture", "example", "sample", "doc", "lock", "changelog", "readme", "mock")
PATH_OPEN = (".env", "config", "setting", "secret", "credential", "deploy", ".tf", ".yml", ".yaml")
PREFIXES = ("AKIA", "ghp_", "gho_", "xox", "sk_", "eyJ", "AIza", "-----BEGIN")
DICTIONARY = frozenset(WORDS) | SPEAKS_FOR | SPEAKS_AGAINST

FEATURES = (
    "length", "log_length", "digits", "upper", "lower", "symbols", "transitions", "distinct", "entropy", "hex", "hex_length", "uuid", "covered", "longest_word", "vowels", "runs",
    "prefix", "placeholder", "in_url", "code", "assigned", "quoted", "name_for", "name_against", "near_for", "near_against", "words_before", "path_safe", "path_open", "all_digits", "separators",
)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of every candidate, in order, none within another."""
    found = [m.span() for m in BLOCK.finditer(text)]
    found += [m.span() for m in JWT.finditer(text)]
    low = text.lower()
    if any(stem in low for stem in STEMS):
        found += [m.span(m.lastindex) for m in ASSIGNED.finditer(text)]
    found += [m.span(1) for m in URL.finditer(text)]
    for m in RUN.finditer(text):
        run = m.group()
        if PLAIN.fullmatch(run) is None or text[max(0, m.start() - AROUND) : m.start()].rstrip(" \"'").endswith(("=", ":")):
            found.append(m.span())
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int]] = []
    for start, end in found:
        if not out or start >= out[-1][1]:
            out.append((start, end))
    return out


def classes(value: str) -> np.ndarray:
    """0 digit, 1 upper, 2 lower, 3 other, for each character."""
    codes = np.frombuffer(value.encode("utf-32-le"), np.uint32)
    out = np.full(len(codes), 3, np.int8)
    for k, (low, high) in enumerate(((48, 57), (65, 90), (97, 122))):
        out[(codes >= low) & (codes <= high)] = k
    return out


def describe(before: str, value: str, after: str, path: str, words: frozenset[str] = frozenset()) -> list[float]:
    """The forest's features of one candidate."""
    n, kind = len(value), classes(value)
    share = np.bincount(kind, minlength=4) / n
    _, counts = np.unique(np.frombuffer(value.encode("utf-32-le"), np.uint32), return_counts=True)
    chance = counts / n
    lower = value.lower()
    is_hex = all(c in "0123456789abcdef" for c in set(lower))
    runs = LETTERS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value))
    known = [w for w in map(str.lower, runs) if w in DICTIONARY or w in words]
    tokens = [w.lower() for w in NAME.findall(before[-AROUND:])]
    left = before.rstrip(" \"'")
    assigned = left.endswith(("=", ":"))
    own = re.split(r"[_\-]", tokens[-1]) if tokens else []
    near = {p for w in tokens[-4:-1] for p in re.split(r"[_\-]", w)} | {w.lower() for w in NAME.findall(after[:AROUND])[:2]}
    place = path.lower()
    repeats = int(np.count_nonzero(np.diff(np.frombuffer(value.encode("utf-32-le"), np.uint32)) == 0))
    return [
        n, float(np.log(n)), share[0], share[1], share[2], share[3], float(np.count_nonzero(np.diff(kind)) / max(n - 1, 1)), len(counts) / n, float(-(chance * np.log2(chance)).sum()),
        is_hex, n if is_hex else 0, bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value)), sum(map(len, known)) / n, max(map(len, known), default=0),
        sum(lower.count(v) for v in "aeiou") / n, repeats / n, value.startswith(PREFIXES), any(p in lower for p in PLACEHOLDER), before.endswith(":") and "://" in before[-AROUND:] and after.startswith("@"), CODE.search(value) is not None, assigned, before[-1:] in ("'", '"'),
        any(w in SPEAKS_FOR for w in own), any(w in SPEAKS_AGAINST for w in own), bool(near & SPEAKS_FOR), bool(near & SPEAKS_AGAINST), len(tokens),
        any(p in place for p in PATH_SAFE), any(p in place for p in PATH_OPEN), share[0] == 1, sum(value.count(c) for c in "_-/") / n,
    ]


@dataclass
class RandomForest:
    """Flattened trees: rows go to ``left[k]`` if their ``column[k]`` is at most ``cut[k]``, else one further; a leaf points at itself."""

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    share: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Mean share of secrets in the leaves that a row reaches."""
        total, at_row = np.zeros(len(rows)), np.arange(len(rows))
        for column, cut, left, share in zip(self.column, self.cut, self.left, self.share, strict=True):
            at = np.zeros(len(rows), np.int32)
            for _ in range(DEPTH):
                down = left[at]
                at = np.where(down != at, down + (rows[at_row, column[at]] > cut[at]), at)
            total += share[at]
        return total / len(self.column)


def best_cut(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Weighted Gini impurity and threshold of the best split of one column; infinite if there is none."""
    order = np.argsort(values, kind="stable")
    v, y = values[order], labels[order]
    n, ones = np.arange(1, len(y)), y.cumsum()[:-1]
    rest, rest_ones = len(y) - n, y.sum() - ones
    impurity = n * 2 * (ones / n) * (1 - ones / n) + rest * 2 * (rest_ones / rest) * (1 - rest_ones / rest)
    impurity[(v[1:] == v[:-1]) | (n < LEAST_ROWS) | (rest < LEAST_ROWS)] = np.inf
    k = int(impurity.argmin())
    return float(impurity[k]), float((v[k] + v[k + 1]) / 2)


def grow_forest(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, seed: int = 17) -> RandomForest:
    """Trees on bootstrap samples, each split chosen among the square root of the columns."""
    rng = np.random.default_rng(seed)
    width, grown = max(1, round(rows.shape[1] ** 0.5)), []
    for _ in range(trees):
        nodes: list[list[float]] = [[0, 0.0, 0, 0.0]]
        todo = [(0, rng.integers(0, len(rows), len(rows)), 0)]
        while todo:
            node, own, depth = todo.pop()
            y = labels[own]
            nodes[node][2], nodes[node][3] = node, float(y.mean())
            if depth == DEPTH or len(own) < 2 * LEAST_ROWS or y.min() == y.max():
                continue
            tried = rng.choice(rows.shape[1], width, replace=False)
            (impurity, cut), k = min((best_cut(rows[own, c], y), int(c)) for c in tried)
            if not np.isfinite(impurity):
                continue
            below = rows[own, k] <= cut
            nodes[node][:3] = [k, cut, len(nodes)]
            todo += [(len(nodes), own[below], depth + 1), (len(nodes) + 1, own[~below], depth + 1)]
            nodes += [[0, 0.0, 0, 0.0], [0, 0.0, 0, 0.0]]
        grown.append(nodes)
    size = max(map(len, grown))
    full = np.array([g + [[0, 0.0, 0, 0.0]] * (size - len(g)) for g in grown])
    return RandomForest(full[:, :, 0].astype(np.int32), full[:, :, 1], full[:, :, 2].astype(np.int32), full[:, :, 3])


@lru_cache(maxsize=1)
def trained() -> RandomForest:
    """The forest, trained on the labelled findings of this package."""
    found = labelled_findings()
    return grow_forest(np.array([describe(*x[:4]) for x in found], float), np.array([x[4] for x in found]))


def scan_text(text: str, path: str) -> tuple[list[tuple[int, int]], list[list[float]]]:
    """Candidates of a text and their features."""
    spans = candidates(text)
    if not spans:
        return [], []
    words = frozenset(w.lower() for w in LETTERS.findall(redact(text, spans, " ")))
    return spans, [describe(text[max(0, a - 2 * AROUND) : a], text[a:b], text[b : b + AROUND], path, words) for a, b in spans]


FINDINGS = "array<struct<start:int,end:int,score:double>>"


def scan(df: DataFrame, forest: RandomForest | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``id_col`` and ``candidates``: start, end (characters) and score of each candidate of each row."""
    model = trained() if forest is None else forest
    sent = df.sparkSession.sparkContext.broadcast(model)  # a fixed number of trees of bounded depth

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, rows, sizes = [], [], []
        for text, path in zip(batch.column(1), batch.column(2), strict=True):
            own, described = scan_text(text.as_py() or "", path.as_py() or "")
            spans += own
            rows += described
            sizes.append(len(own))
        scores = sent.value.score(np.array(rows, float)) if rows else []
        found = pa.array([{"start": a, "end": b, "score": round(float(s), 6)} for (a, b), s in zip(spans, scores, strict=True)], pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return pa.record_batch([batch.column(0), pa.ListArray.from_arrays(ends, found)], names=[id_col, "candidates"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(id_col, F.col(text_col).alias("text"), F.col(path_col).alias("path"))
    return arrow_map(rows, kernel, f"{id_col} {kind}, candidates {FINDINGS}")


def redact(text: str, findings: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """A text with the given spans replaced."""
    out, at = [], 0
    for start, end in findings:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    secrets = F.filter("candidates", lambda x: x["score"] >= LEAST_SCORE)
    spans = F.array_join(F.transform(secrets, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        "doc_id", F.size("candidates").cast("long").alias("n_candidates"), F.size(secrets).cast("long").alias("n_secrets"), spans.alias("spans"),
        F.round(F.array_max(F.transform("candidates", lambda x: x["score"])), 4).alias("max_score"),
    )
