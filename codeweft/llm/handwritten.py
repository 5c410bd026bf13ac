"""Telling hand-written source files from generated, minified, vendored ones and data blobs (problem 1).

Linear support-vector classifiers, one per kind, on hashed character n-grams and hashed path components. Three blocks of
features: n-grams of the bodies without their leading comments, n-grams of the lines of the leading comments (where
giveaway headers stand), and components of the path; besides, the shares of stubs and of bodies that other repositories
hold as well. Nothing that makes a label is a feature.

There are no labels, so the fit begins with labelling rules that name only clear cases (a notice that a tool wrote the
file, a package manager's folder, one line of thousands of characters). Each clear case is shown to the learner twice: as
it is, and masked, that is without its leading comments and its path, so that the body's make is learnt as well. Code of
other projects looks like any other, so the masked view is left out for that kind. Repositories, not files, are split
between fit and validation.

The fit takes at most ``FIT_FILES`` files, whole. Everything else covers all rows. N-grams are hashed and counted on the
executors; the sums of a file's rows add up, so files of any size are scored without bringing their bodies together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm.tokens import spread
from codeweft.plans.materialize import materialize

KINDS = ("generated", "minified", "vendored", "data")
FIT_FILES = 5000
HASHED = 1 << 12
PATH_HASHED = 1 << 12
COMMENT_HASHED = 1 << 11
GRAM = 4
COMMENT_GRAM = 5
#: Lengths of the blocks in the learner's space; a scale of 1 is about the reach of a margin.
BODY_SCALE, COMMENT_SCALE, PATH_SCALE, STUB_SCALE = 1.0, 2.0, 0.8, 0.5
#: Cost of a masked row beside that of the row as it is.
MASKED_COST = 0.5
VALIDATION_SHARE = 5  # one repository in five

# ---- notices ----------------------------------------------------------------------------------------------------------

_TOOL_NOTICE = re.compile(
    r"auto-?\s?generated\b|<auto-generated|@generated\b|\bcode generated\b|\bgenerated (?:by|from|with|using|code|file|on)\b|^\W*generated\b(?!.*\bvariant\b)|\bdo not (?:edit|modify|touch|change)\b|\bedits? (?:are|is|will be|get) (?:overwritten|lost)|\bchanges will be (?:lost|overwritten)|\b(?:produced|created|written|emitted) automatically\b|\bautomatically (?:produced|created|generated|written)\b|\bmachine-written\b|\b(?:dump|file|output) (?:written|produced|created|emitted) by\b|\bemitted by \w+ \d|\brebuild with `|\bautomatisch (?:erzeugt|generiert)\b|\bnicht (?:von hand|manuell) ändern\b|\best généré|ne pas modifier\b|\bgenerado automáticamente\b|\bno (?:editar|modificar)\b|\bgerado automaticamente\b|\bnão (?:editar|edite|modifi\w+)\b|\bwygenerowan\w+ automatycznie\b|\bnie edytowa\w+\b|\bсгенерирован\w* автоматически\b|\bне (?:редактировать|изменять)\b|自動生成|編集しないで|edit \S+\.\w+ instead",
    re.I,
)
_COPY_NOTICE = re.compile(
    r"^\W*vendored\b|\bthird-?party source\b|\bcopied (?:verbatim |unchanged )?from (?:upstream|the)\b|\bfrom upstream\b|\bimported from the \S+ project\b|\bkept in tree because\b|\bregistry copy\b|\bunder its own licen[cs]e\b|\bsee upstream\b|\bthe \S+ authors\b|\breleased under (?:the )?(?:apache|mit|bsd|gpl|lgpl|mpl|isc)\b|^\W*!?\s*[\w.-]+ v?\d+\.\d+(?:\.\d+)?\b.*\|.*licen[cs]e|\b(?:mit|bsd|apache|isc|mpl) licen[cs]e\b.*\(c\)|\(c\).*\b(?:mit|bsd|apache|isc|mpl)\b",
    re.I,
)
_PACKED = re.compile(r"^/\*{2,}/ \(|^//\s*packed module|__wrap\(\{|^define\(\"\w+\", \[|^webpackJsonp|^\(self\[\"webpack|^System\.register\(|^!function\(|^\(function\(\w(?:,\w)*\)\{", re.M)
_PACKED_SIGNS = ("/***", "packed module", "__wrap(", "define(\"", "webpack", "System.register", "!function", "(function(")
_OWN_NOTICE = re.compile(r"hand-?\s?(?:tuned|written|made)|\bpart of this (?:workspace|project|repository)\b|\binternal use only\b|\bwritten by the\b", re.I)
_COMMENT = re.compile(r"\s*(?:<!--.*?-->|/\*.*?\*/|(?://|#(?!\[|!\[)|--)[^\n]*(?:\n|$))", re.S)


def leading_comment(body: str) -> str:
    """The comments that a body begins with."""
    at = 0
    while True:
        m = _COMMENT.match(body, at)
        if not m or m.end() == at:
            return body[:at]
        at = m.end()


_MARKS = re.compile(r"^[\s/*#!<>-]+|[\s/*>-]+$", re.M)


def notice(comment: str) -> tuple[bool, bool, bool]:
    """(a tool wrote it, copied from elsewhere, own notice) by a leading comment."""
    lines = [_MARKS.sub("", x) for x in comment.splitlines()]
    lines = [x for x in lines if x]
    tool = any(_TOOL_NOTICE.search(x) for x in lines)
    copy = any(_COPY_NOTICE.search(x) for x in lines)
    own = any(_OWN_NOTICE.search(x) for x in lines)
    if own and not any(re.search(r"do not (?:edit|modify)|@generated|auto-?generated", x, re.I) for x in lines):
        tool = False
    return tool, copy, own


# ---- paths ------------------------------------------------------------------------------------------------------------

_PACKAGES = re.compile(r"(?:^|/)(?:node_modules|bower_components|site-packages|dist-packages|jspm_packages|Pods|Carthage|\.build/checkouts|\.venv|\.tox|\.cargo/registry|elm-stuff)/")
_COPIED = re.compile(r"(?:^|/)(?:vendor|_vendor|vendored|third_party|thirdparty|third-party|3rdparty|external|extern|deps)/[^/]+/[^/]+")
_VERSIONED = re.compile(r"(?:^|/)[a-z][a-z0-9_.]*-v?\d+\.\d+(?:\.\d+)*/", re.I)
_MADE = re.compile(r"(?:^|/)(?:gen|generated|__generated__|autogen|codegen-out)/|\.pb\.\w+$|_pb2(?:_grpc)?\.py$|\.g\.\w+$|[._]generated\.\w+$|\.gen\.\w+$|\.designer\.\w+$")
_SHRUNK = re.compile(r"\.min\.\w+$|\.bundle\.\w+$|\.chunk\.\w+$|\.umd\.\w+$|-[0-9a-f]{7,10}\.js$")
_BLOB = re.compile(r"_b64\.\w+$|_blob\.\w+$|_base64\.\w+$")
_PART = re.compile(r"[/]")


def path_parts(path: str) -> list[str]:
    """Components of a path below its repository, with their depth from the end for folders, and parts of the name."""
    parts = path.split("/")[1:] or [path]
    out = [f"d:{p}" for p in parts[:-1]]
    out += ["v:versioned"] * any(_VERSIONED.match(p + "/") for p in parts[:-1])
    out += [f"t:{parts[0]}"] if len(parts) > 1 else []
    name = parts[-1]
    stem, *exts = name.split(".")
    out += [f"x:{'.'.join(exts)}"] + [f"e:{e}" for e in exts]
    words = re.split(r"[_-]", stem)
    out += [f"l:{words[-1] if not re.fullmatch(r'[0-9a-f]{6,}', words[-1]) else '#'}"] if len(words) > 1 else []
    out += ["n:digits"] if re.match(r"\d+_", stem) else []
    return out


def _hash(s: str, size: int) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(s) % size


# ---- bodies -----------------------------------------------------------------------------------------------------------

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[128:] = 128
_SHAPE[ord("\r")] = ord("\n")


#: Bodies are hashed together in pieces of about this many bytes.
PIECE_BYTES = 1 << 21
_GAP = bytes(GRAM + 2)


def pieces(datas: list[bytes]) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``PIECE_BYTES``; a longer body is a range of its own."""
    start = size = 0
    for i, d in enumerate(datas):
        if size and size + len(d) > PIECE_BYTES:
            yield start, i
            start, size = i, 0
        size += len(d)
    if start < len(datas):
        yield start, len(datas)


def grams(datas: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash values, row of each) of the character n-grams of some bodies: of the shape (letters and digits as classes,
    runs of letters and blanks cut to three) and of the characters as they are. Rows ascend within each of the two."""
    raw = np.frombuffer(b"".join(x for d in datas for x in (d, _GAP)), np.uint8)
    owner = np.repeat(np.arange(len(datas), dtype=np.int32), [len(d) + len(_GAP) for d in datas])
    shape = _SHAPE[raw]
    own2 = owner
    if len(shape) > 3:
        same = (shape[1:] == shape[:-1]) & ((shape[1:] == 97) | (shape[1:] == 32))
        keep = np.ones(len(shape), bool)
        keep[3:] = ~(same[2:] & same[1:-1] & same[:-2])
        shape, own2 = shape[keep], owner[keep]
    hashes, owners = [], []
    for k, (x, o, n) in enumerate(((shape, own2, GRAM + 2), (raw, owner, GRAM))):
        if len(x) >= n:
            size = len(x) - n + 1
            h = np.zeros(size, np.uint32)
            for i in range(n):
                h *= np.uint32(0x01000193)
                h += x[i : size + i]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B + 2 * k)
            h ^= h >> np.uint32(13)
            h &= np.uint32(HASHED // 2 - 1)
            hashes.append(h + np.uint32(k * (HASHED // 2)))
            owners.append(o[:size])
    return (np.concatenate(hashes), np.concatenate(owners)) if hashes else (np.zeros(0, np.uint32), np.zeros(0, np.int32))


def gram_scores(datas: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Per body the sums of ``weights`` (hash x kinds) over its n-grams, and their number in the last column."""
    out = np.zeros((len(datas), weights.shape[1] + 1))
    for a, b in pieces(datas):
        h, o = grams(datas[a:b])
        w = weights[h]
        for j in range(weights.shape[1]):
            out[a:b, j] += np.bincount(o, w[:, j], minlength=b - a)
        out[a:b, -1] += np.bincount(o, minlength=b - a)
    return out


_DIGITS = re.compile(r"[0-9]+")
_RULES = re.compile(r"[\s/*#!<>=-]+")


def comment_grams(comments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash values, row of each, weight of each) of the character n-grams of the lines of some comments, in lower case,
    with numbers as 0. The n-grams of a line weigh one together in square, however long the line or the comment."""
    lines, owners = [], []
    for i, c in enumerate(comments):
        for line in c.splitlines() if c else ():
            line = _RULES.sub(" ", _DIGITS.sub("0", line.lower())).strip()
            if line:
                lines.append(f" {line} ".encode("utf-8", "replace"))
                owners.append(i)
    sizes = np.array([len(x) for x in lines], np.int64)
    if not len(sizes) or sizes.sum() < COMMENT_GRAM:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0)
    raw = np.frombuffer(b"".join(lines), np.uint8)
    at = np.repeat(np.arange(len(lines)), sizes)
    size = len(raw) - COMMENT_GRAM + 1
    h = np.zeros(size, np.uint32)
    for i in range(COMMENT_GRAM):
        h *= np.uint32(0x01000193)
        h += raw[i : size + i]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    inside = at[:size] == at[COMMENT_GRAM - 1 :]
    line = at[:size][inside]
    per_line = np.bincount(line, minlength=len(lines))
    return h[inside] & np.uint32(COMMENT_HASHED - 1), np.array(owners)[line], 1.0 / np.sqrt(per_line[line])


def comment_scores(comments: list[str], weights: np.ndarray) -> np.ndarray:
    """Per comment the sums of ``weights`` (hash x kinds) over its n-grams."""
    h, o, c = comment_grams(comments)
    return np.stack([np.bincount(o, weights[h, j] * c, minlength=len(comments)) for j in range(weights.shape[1])], axis=1) if len(comments) else np.zeros((0, weights.shape[1]))


_LITERAL = re.compile(rb"-?\b\d+(?:\.\d+)?\b[,)\s]|0x[0-9a-fA-F]{2,}[,\s]|\"[A-Za-z0-9+/=]{24,}\"")
_ACCESS = re.compile(rb"0x[0-9a-f]{7,8}\b")
TRAITS = ("tool", "copy", "own", "packed", "longest", "bytes", "lines", "digits", "blanks", "literal", "hexes", "stub", "constant", "inserts", "rows", "copied", "sized")


def traits(bodies: list[str], datas: list[bytes], comments: list[str], kinds: list[str | None], stubs: list[bool]) -> np.ndarray:
    """Measured traits of some bodies, a row each in the order of :data:`TRAITS` (without the last two); all but the flags
    and ``longest`` add up over a file."""
    out = np.zeros((len(bodies), len(TRAITS) - 2))
    for i, (body, data, comment, kind, stub) in enumerate(zip(bodies, datas, comments, kinds, stubs)):
        if comment:
            out[i, 0:3] = notice(comment)
        out[i, 3] = any(k in body for k in _PACKED_SIGNS) and bool(_PACKED.search(body))
        out[i, 4] = max(map(len, data.split(b"\n")))
        out[i, 9] = sum(map(len, _LITERAL.findall(data))) if kind in ("constant", "const", "variable", "struct") else 0
        out[i, 10] = len(_ACCESS.findall(data)) if b"0x" in data else 0
        out[i, 11:15] = stub, kind in ("constant", "const"), data.count(b"INSERT INTO"), 1
    sizes = np.array([len(d) for d in datas])
    out[:, 5] = sizes
    out[:, 6] = 1
    full = np.flatnonzero(sizes)
    for a, b in pieces([datas[i] for i in full]):
        rows = full[a:b]
        x = np.frombuffer(b"".join(datas[i] for i in rows), np.uint8)
        at = np.cumsum(sizes[rows]) - sizes[rows]
        line = np.add.reduceat((x == 10).astype(np.int64), at)
        out[rows, 6] += line
        out[rows, 7] = np.add.reduceat(((x >= 48) & (x <= 57)).astype(np.int64), at)
        out[rows, 8] = np.add.reduceat((x == 32).astype(np.int64), at) + line
    return out


def clear_case(path: str, t: dict[str, float]) -> str | None:
    """The kind of a clear case by notice, path or make; ``""`` for clearly hand-written, None where it is open."""
    below = path.split("/", 1)[-1]
    rows, size, lines = max(t["rows"], 1.0), max(t["bytes"], 1.0), max(t["lines"], 1.0)
    if t["copy"] or _PACKAGES.search(below) or _COPIED.search(below) or _VERSIONED.search(below):
        return "vendored"
    blanks = t["blanks"] / size
    if t["packed"] or (size / lines > 300 and blanks < 0.08):
        return "minified"
    if t["literal"] / size > 0.5 and size > 800 or t["inserts"] / rows > 15:
        return "data"
    if t["tool"]:
        return "generated"
    if t["hexes"] / rows > 0.9 and t["rows"] > 1:
        return "generated"
    if _MADE.search(below) or _SHRUNK.search(below) or _BLOB.search(below) or _COPIED.search(below) or size / lines > 300 or t["literal"] / size > 0.3 or t["inserts"] / rows > 3 or t["hexes"] / rows > 0.3:
        return None
    if t["sized"] and t["copied"] / t["sized"] > 0.5:
        return None
    return ""


# ---- the classifier ---------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Weights of all kinds (a row each): of the n-grams of bodies, the n-grams of comments, path components and the shares
    of stubs and of copied bodies, and the intercepts."""

    gram: np.ndarray
    comment: np.ndarray
    path: np.ndarray
    share: np.ndarray
    bias: np.ndarray
    #: kind -> validation files of the kind that are found without their leading comments and paths
    masked: dict[str, int]

    def margins(self, gram_sums: np.ndarray, n_grams: float, comment_sums: np.ndarray, path: str, stub: float, copied: float) -> np.ndarray:
        m = self.bias + comment_sums + self.share @ np.array([stub, copied])
        if n_grams:
            m = m + gram_sums / n_grams
        idx = [_hash(p, PATH_HASHED) for p in path_parts(path)]
        return m + self.path[:, idx].sum(axis=1)


def fit_svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, cut: int, epochs: int = 60, seed: int = 7) -> np.ndarray:
    """Linear SVM (hinge loss, L2) by dual coordinate descent on two views of every row: whole, and its first ``cut`` columns
    only. ``c`` has the cost of the whole rows, then that of the cut ones; 0 leaves one out."""
    n, d = x.shape
    w, alpha = np.zeros(d, np.float32), np.zeros(2 * n)
    head = x[:, :cut]
    norm = np.concatenate([np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", head, head)]).astype(np.float64) + 1e-9
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        g = np.concatenate([y * (x @ w), y * (head @ w[:cut])]) - 1
        open_rows = np.flatnonzero(((g < -1e-3) & (alpha < c)) | ((g > 1e-3) & (alpha > 0)))  # only these can move
        if not len(open_rows):
            break
        for i in rng.permutation(open_rows):
            row, v = (x[i], w) if i < n else (head[i - n], w[:cut])
            t = y[i % n]
            g = t * float(row @ v) - 1
            a = min(max(alpha[i] - g / norm[i], 0.0), c[i])
            if a != alpha[i]:
                v += np.float32((a - alpha[i]) * t) * row
                alpha[i] = a
    return w


def fit(files: pd.DataFrame) -> tuple[Model, dict[str, tuple[int, int, int]]]:
    """(model, {kind: (validation files of the kind, found, found in all)}) from one row per file: ``path``,
    the label's traits, ``copied``, ``sized``, ``at`` and ``counts`` (hashed counts, see :func:`unpacked`). The masked row of
    a file has neither leading comments nor a path."""
    cases = [clear_case(p, t) for p, t in zip(files["path"], files[list(TRAITS)].to_dict("records"))]
    use = [i for i, c in enumerate(cases) if c is not None]
    n, cut = len(use), HASHED + 3
    x = np.zeros((n, cut + COMMENT_HASHED + PATH_HASHED), np.float32)
    for r, i in enumerate(use):
        v = unpacked(files["at"].iloc[i], files["counts"].iloc[i])
        x[r, :HASHED], x[r, cut : cut + COMMENT_HASHED] = v[:HASHED], v[HASHED:]
        for part in path_parts(files["path"].iloc[i]):
            x[r, cut + COMMENT_HASHED + _hash(part, PATH_HASHED)] += PATH_SCALE
        x[r, HASHED : cut] = _shares(*(float(files[k].iloc[i]) for k in ("stub", "rows", "copied", "sized"))) + (1.0,)
    g = x[:, :HASHED]
    g /= np.maximum(g.sum(axis=1, keepdims=True), 1)
    scale = np.ones(HASHED, np.float32)
    if n:
        for a in range(0, HASHED, 512):  # in parts, so that no second matrix is needed
            scale[a : a + 512] = 1.0 / (g[:, a : a + 512].std(axis=0) + 2e-4)
        scale *= BODY_SCALE / max(1e-9, float(np.sqrt(np.mean([((row * scale) ** 2).sum() for row in g]))))
    g *= scale
    x[:, cut : cut + COMMENT_HASHED] *= COMMENT_SCALE
    kind = np.array([cases[i] for i in use], dtype=object)
    held = np.array([_hash(files["path"].iloc[i].split("/", 1)[0], VALIDATION_SHARE) == 0 for i in use], bool)

    def weights(rows: np.ndarray) -> np.ndarray:
        out = []
        for k in KINDS:
            mine = kind == k
            if not (mine & rows).any() or not (~mine & rows).any():
                w = np.zeros(x.shape[1])
                w[cut - 1] = -1.0
                out.append(w)
                continue
            cost = np.where(mine, min(6.0, (~mine & rows).sum() / (mine & rows).sum()) ** 0.5, 1.0) * rows
            out.append(fit_svm(x, np.where(mine, 1.0, -1.0), np.concatenate([cost, cost * MASKED_COST * (k != "vendored")]), cut))
        return np.stack(out)

    report, hidden = {}, {}
    if held.any() and (~held).any():
        w = weights(~held)
        m, bare = x[held] @ w.T, x[held, :cut] @ w[:, :cut].T
        for j, k in enumerate(KINDS):
            truth = kind[held] == k
            report[k] = (int(truth.sum()), int((truth & (m[:, j] > 0)).sum()), int((m[:, j] > 0).sum()))
            hidden[k] = int((truth & (bare[:, j] > 0)).sum())
    if n:
        w = weights(np.ones(n, bool))
    else:
        w = np.zeros((len(KINDS), x.shape[1]))
        w[:, cut - 1] = -1.0
    return Model(*(a.astype(np.float32) for a in (w[:, :HASHED] * scale, w[:, cut : cut + COMMENT_HASHED] * COMMENT_SCALE, w[:, cut + COMMENT_HASHED :] * PATH_SCALE, w[:, HASHED : cut - 1], w[:, cut - 1])), hidden), report


def _shares(stub: float, rows: float, copied: float, sized: float) -> tuple[float, float]:
    """Shares of stub rows and of bodies that another repository has as well, as the learner sees them."""
    return STUB_SCALE * stub / max(rows, 1.0), copied / max(sized, 1.0)


# ---- over tables ------------------------------------------------------------------------------------------------------


def _rows(symbols: DataFrame) -> DataFrame:
    """The columns in use; rows without a path are left out, null bodies count as empty."""
    return symbols.where(F.col("file_path").isNotNull()).select(
        F.col("file_path").cast("string").alias("path"), F.coalesce(F.col("body").cast("string"), F.lit("")).alias("body"), F.lower(F.trim(F.col("kind").cast("string"))).alias("kind"), F.coalesce(F.col("is_stub").cast("boolean"), F.lit(False)).alias("stub")
    )


_MOST = ["tool", "copy", "own", "packed", "longest"]


def _copied(rows: DataFrame) -> DataFrame:
    """``path``, ``copied``, ``sized``: bodies of some size per file, and those found in another repository as well."""
    big = rows.where(F.octet_length("body") >= 160).select("path", F.xxhash64("body").alias("h"), F.xxhash64(F.substring_index("path", "/", 1)).alias("repo"))
    big = big.distinct()
    wide = big.groupBy("h").agg((F.min("repo") != F.max("repo")).alias("wide")).where("wide").select("h", "wide")
    return big.join(wide, "h", "left").groupBy("path").agg(F.count("wide").cast("double").alias("copied"), F.count(F.lit(1)).cast("double").alias("sized"))


_LABEL = [*TRAITS[:-2]]
_COUNTED = HASHED + COMMENT_HASHED
#: Stages in which the counts of a file are added up, so that a file in very many tasks is in none as a whole.
_FAN = 256


def _counted(rows: DataFrame) -> DataFrame:
    """``path``, the label's traits and ``counts``: the n-gram counts of bodies and comments, non-zero ones as
    (positions, values) in bytes; a row per file."""
    schema = "path string, part int, " + ", ".join(f"{k} double" for k in _LABEL) + ", at binary, counts binary"

    def packed(path: str, part: int, t: np.ndarray, v: np.ndarray) -> dict:
        at = np.flatnonzero(v)
        return {"path": path, "part": part, **dict(zip(_LABEL, t)), "at": at.astype(np.uint16).tobytes(), "counts": v[at].astype(np.float32).tobytes()}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() % _FAN if context else 0
        sums: dict[str, list[np.ndarray]] = {}  # at most a row per file of the sample
        for pdf in batches:
            for path, some in pdf.groupby("path", sort=False):
                bodies, comments, datas, masked = _prepared(some["body"])
                t = traits(bodies, datas, comments, list(some["kind"]), list(some["stub"]))
                t = np.concatenate([t[:, : len(_MOST)].max(axis=0), t[:, len(_MOST) :].sum(axis=0)])
                v = np.zeros(_COUNTED, np.float32)
                for a, b in pieces(masked):
                    v[:HASHED] += np.bincount(grams(masked[a:b])[0], minlength=HASHED)
                h, _, c = comment_grams(comments)
                v[HASHED:] += np.bincount(h, c, minlength=COMMENT_HASHED)
                _add(sums, path, t, v)
        yield pd.DataFrame([packed(p, part, t, v) for p, (t, v) in sums.items()], columns=[c.split()[0] for c in schema.split(", ")])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, list[np.ndarray]] = {}
        for pdf in batches:
            for r in pdf.to_dict("records"):
                _add(sums, r["path"], np.array([r[k] for k in _LABEL]), unpacked(r["at"], r["counts"]))
        yield pd.DataFrame([packed(p, 0, t, v) for p, (t, v) in sums.items()], columns=[c.split()[0] for c in schema.split(", ")])

    once = rows.mapInPandas(count, schema)
    return once.repartition("path", "part").mapInPandas(add, schema).repartition("path").mapInPandas(add, schema).drop("part")


def _add(sums: dict[str, list[np.ndarray]], path: str, t: np.ndarray, v: np.ndarray) -> None:
    held = sums.get(path)
    if held is None:
        sums[path] = [t, v]
        return
    k = len(_MOST)
    held[0][:k] = np.maximum(held[0][:k], t[:k])
    held[0][k:] += t[k:]
    held[1] += v


def unpacked(at: bytes, counts: bytes) -> np.ndarray:
    v = np.zeros(_COUNTED, np.float32)
    v[np.frombuffer(at, np.uint16)] = np.frombuffer(counts, np.float32)
    return v


def fit_on(symbols: DataFrame, fit_files: int = FIT_FILES) -> tuple[Model, dict[str, tuple[int, int, int]]]:
    """Fit on a bounded sample of files: those with the smallest hashes of their paths."""
    rows = _rows(symbols)
    paths = materialize(rows.select("path").distinct().orderBy(F.xxhash64("path"), "path").limit(fit_files), "sample")
    some = rows.join(F.broadcast(paths), "path", "left_semi")  # at most fit_files paths
    copied = _copied(rows).join(F.broadcast(paths), "path", "left_semi")
    files = _counted(spread(some)).join(copied, "path", "left").na.fill(0.0, ["copied", "sized"]).orderBy("path").toPandas()
    return fit(files)


def _prepared(bodies: pd.Series) -> tuple[list[str], list[str], list[bytes], list[bytes]]:
    """(bodies, their leading comments, their bytes, their bytes without the leading comments, where notices stand)."""
    texts = list(bodies)
    comments = [leading_comment(b) for b in texts]
    datas = [b.encode("utf-8") for b in texts]
    return texts, comments, datas, [d[len(c.encode("utf-8")) :] if c else d for d, c in zip(datas, comments)]


def classify(symbols: DataFrame, model: Model) -> DataFrame:
    """``file_path``, ``kind`` (of the largest margin), ``margin`` of every file; ``kind`` is null for hand-written files.

    A file is every row with its path. Rows without a path are ignored, null and empty bodies add nothing, repeated rows
    weigh double and change little else. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = _rows(symbols)
    shared = symbols.sparkSession.sparkContext.broadcast(model)  # fixed size: kinds x hashed features
    n = len(KINDS)
    names = ["stub", "rows", *[f"c{j}" for j in range(n)], *[f"m{j}" for j in range(n)], "grams"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, wc = np.ascontiguousarray(shared.value.gram.T), np.ascontiguousarray(shared.value.comment.T)
        for pdf in batches:
            if not len(pdf):
                continue
            _, comments, _, masked = _prepared(pdf["body"])
            part = pd.DataFrame(np.hstack([pdf["stub"].to_numpy(float)[:, None], np.ones((len(pdf), 1)), comment_scores(comments, wc), gram_scores(masked, w)]), columns=names)
            # combined in the task, so a hot file sends one row per batch
            yield part.groupby(pdf["path"].to_numpy()).sum()[names].rename_axis("path").reset_index()

    sums = spread(rows.select("path", "body", "stub")).mapInPandas(score, "path string, " + ", ".join(f"{c} double" for c in names))
    per_file = sums.groupBy("path").agg(*[F.sum(c).alias(c) for c in names])
    per_file = per_file.join(_copied(rows), "path", "left").na.fill(0.0, ["copied", "sized"])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                v = m.margins(np.array([r[f"m{j}"] for j in range(n)]), r["grams"], np.array([r[f"c{j}"] for j in range(n)]), r["path"], *_shares(r["stub"], r["rows"], r["copied"], r["sized"]))
                j = int(np.argmax(v))
                out.append((r["path"], KINDS[j] if v[j] > 0 else None, float(v[j])))
            yield pd.DataFrame(out, columns=["file_path", "kind", "margin"])

    return per_file.mapInPandas(decide, "file_path string, kind string, margin double")
