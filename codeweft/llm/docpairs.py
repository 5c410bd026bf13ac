"""Functions paired with their documentation (problem 3).

The documentation of a callable is its ``docstring`` or, where that is null, the comment in its body at the place usual
for the language. Callables without any are looked up in a qualified symbol table: documented declarations (stubs,
interface rows without a body) of the same workspace and language with the same qualified name; overloads are told apart
by normalised signatures and the types of their parameters. Documentation that says nothing beyond name, parameters and types is dropped afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.plans.materialize import materialize
from codeweft.sources.tables import canonical_kind

CALLABLE = ("function", "async_function", "method", "async_method")
_FAMILY = {"jsx": "javascript", "tsx": "typescript"}

# ---- comment text ---------------------------------------------------------------------------------------------------

_BLOCK = re.compile(r"^\s*(?:/\*+!?|<!--|\"\"\"|''')|(?:\*+/|-->|\"\"\"|''')\s*$")
_LINE_MARK = re.compile(r"^\s*(?:///?!?(?!/)|//+|#+!?(?=\s|$)|#+(?=[^\[\w!])|--+(?=\s|$)|\*+(?!\w)(?=\s|$|/)|;+(?=\s))\s?")


def bare(comment: str) -> str:
    """A comment without its markers; lines stay lines."""
    text = comment.replace("\r\n", "\n").replace("\r", "\n")
    while True:
        cut = _BLOCK.sub("", text)
        if cut == text:
            break
        text = cut
    return "\n".join(_LINE_MARK.sub("", line).rstrip() for line in text.split("\n")).strip()


_COMMENT_LINE = re.compile(r"\s*(?://|#(?!\[|!\[)|--)")
_DECORATOR = re.compile(r"\s*(?:@\w|#!?\[)")
_PY_DEF = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+\w+[ \t]*(?:\[[^\]]*\])?\(", re.M)
_PY_STRING = re.compile(r"(?:[ \t\r\n]|#[^\n]*\n|\\\n)*[rRuUbB]{0,2}(\"\"\"|'''|\"|')")


def comment_in_body(body: str, language: str | None) -> str | None:
    """The documentation comment in a body: the docstring of Python, else the comment directly above the signature."""
    if (language or "").strip().lower() in ("python", "py"):
        return _python_docstring(body)
    lines = body.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    i, n = 0, len(lines)
    block: list[str] = []
    while i < n:
        line = lines[i]
        text = line.strip()
        if not text:
            block = []  # what stands above a blank line is not directly above the signature
            i += 1
        elif text.startswith("/*"):
            start = i
            while i < n and "*/" not in lines[i][lines[i].find("/*") + 2 if i == start else 0 :]:
                i += 1
            if i < n and lines[i].split("*/", 1)[1].strip():
                return "\n".join(block).strip() or None if start != i else None
            block = lines[start : i + 1]
            i += 1
        elif _COMMENT_LINE.match(line) and not text.startswith("#!"):
            block = [*block, line] if block and not block[-1].rstrip().endswith("*/") else [line]
            i += 1
        elif _DECORATOR.match(line):
            i += 1
        else:
            break
    return "\n".join(block) if block and i < n else None


def _python_docstring(body: str) -> str | None:
    m = _PY_DEF.search(body)
    if not m:
        return None
    depth, i, n = 1, m.end(), len(body)
    while i < n and depth:
        c = body[i]
        depth += c in "([{"
        depth -= c in ")]}"
        if c in "\"'":
            j = body.find(c, i + 1)
            i = j if j > 0 else i
        elif c == "#":
            j = body.find("\n", i)
            i = j if j > 0 else n
        i += 1
    while i < n and body[i] != ":":
        if body[i] == "[":
            i = body.find("]", i)
            if i < 0:
                return None
        i += 1
    s = _PY_STRING.match(body, i + 1)
    if not s:
        return None
    quote = s.group(1)
    end = s.end()
    while True:
        end = body.find(quote, end)
        if end < 0:
            return None
        if body[end - 1] != "\\":
            break
        end += 1
    text = body[s.end() : end]
    if len(quote) == 1 and "\n" in text:
        return None
    return text


# ---- what a comment says ----------------------------------------------------------------------------------------------

_BANNER = re.compile(
    r"copyright|\(c\)|©|licen[sc]e|spdx|all rights reserved|do not (?:edit|modify)|auto-?generated|code generated|@generated|<auto-generated|generated (?:by|from|file|code)|generated \w+ bindings|edits? (?:are|will be) (?:overwritten|lost)|produced automatically|ne pas modifier|nicht bearbeiten|vendored|third-party source|verbatim from upstream|this file (?:is|was)|packed module",
    re.I,
)
#: Instructions to tools, by their first words.
_DIRECTIVE = re.compile(
    r"^\W*(?:noqa\b|type:\s*ignore|pylint\b|flake8\b|mypy\b|ruff\b|isort\b|yapf\b|black\b\s*:|pyright\b|nosec\b|pragma\b|fmt\s*:|eslint\b|eslint-|tslint\b|jshint\b|jslint\b|biome-|prettier-|istanbul\b|c8 ignore|v8 ignore|ts-(?:ignore|expect-error|nocheck|check)|@ts-|rustfmt\b|clippy\b|cargo-\w+\s*:|swiftlint\b|swiftformat\b|mark\s*:|shellcheck\b|shfmt\b|sqlfluff\b|noinspection\b|nolint\b|region\b|endregion\b|webpack\w+:|sourcery\b|codespell\b|cspell\b|spell-?checker\b|coverage\b\s*:|deno-\w+|language=|vim:|-\*-)|^\W*\w[\w-]*\s*:+\s*(?:disable|enable|ignore|skip|allow|off|on)\b[\w\s:,-]*$|^\W*@(?:internal|private|public|protected|override|deprecated|experimental|alpha|beta|hidden|ignore|nodoc|async|static|abstract|final|virtual|readonly|inner|instance|memberof|module|function|method|export|api)\b[.\s]*$",
    re.I,
)
_TODO = re.compile(r"^\W*(?:to-?do|fixme|xxx+|tbd|tba|hack|wip)\b", re.I)
#: Sentences about the missing documentation instead of the code.
_FILLER = re.compile(
    r"^\W*(?:"
    r"missing (?:doc\w*|parameters?|return values?|descriptions?)|(?:un|not |not yet |to be |will be |needs to be )documented(?: later| soon| yet)?|no (?:doc\w*|descriptions?|comments?|summary)\b.*|document (?:this|me)|write (?:me|this|docs?)|(?:add|insert|write|put) (?:doc\w*|descriptions?|comments?|text)\b.*|"
    r"(?:doc\w*|descriptions?|comments?|text|summary) (?:goes|go|comes|here|stub|missing|pending|to follow|needed)\b.*|placeholder.*|_?(?:summary|description|extended_summary|type)_?|descriptions?|summary|docstring|documentation|comment|n/?a|none|nothing|empty|todo.*|"
    r"replace this (?:text|comment|line)\b.*|this (?:comment|doc\w*|text|description) (?:was|is|has been) (?:left )?(?:empty|blank|missing)\b.*|filler text\b.*|lorem ipsum\b.*|still to be (?:replaced|written|documented)\b.*|coming soon|self[- ]explanatory|stub|dummy(?: text)?|foo|bar|blah(?: blah)*|asdf|x+|"
    r"(?:à|a) documenter|por documentar|a documentar|documentar|noch zu dokumentieren|beschreibung (?:folgt|fehlt)|ohne beschreibung|sin descripci[oó]n|sem descri[cç][aã]o|sans description|brak opisu|нет описания|без описания|описание отсутствует|説明なし|未記入|未定"
    r")\W*$",
    re.I,
)
_REFERENCE = re.compile(
    r"^\W*(?:\{?@inheritdoc\}?|inherit(?:s|ed)?(?: (?:from|docs?|documentation)\b.*)?|see (?:also\b.*|above|below|base(?: class)?|parent(?: class)?|super(?:class)?|the (?:base|parent|super|interface|overridden|original)\b.*|overridden\b.*|interface\b.*|[`\w.:#()/]+)|@(?:see|link|copydoc|inherit)\b.*|same as (?:the )?(?:parent|above|base|super|below|before|[`\w.:#()]+)(?: class| method)?|as above|ditto|idem|"
    r"overrides? (?:the )?(?:parent|base|super|inherited)\w*(?: class)?(?:'s)?(?: method| function| implementation)?|overrides? [`\w.:#()]+|implements? (?:the )?(?:interface|protocol|trait|base|parent|abstract)(?: method| member)?|(?:please )?refer to\b.*|for (?:details|documentation|more)\b.* see\b.*|documented (?:in|at|on)\b.*|copied from\b.*|@?alias (?:of|for)\b.*|siehe (?:oben|basisklasse)|voir (?:ci-dessus|la classe parente)|ver (?:arriba|acima)|см\. выше|上記参照)\W*$",
    re.I,
)

_TAGS = (
    re.compile(r"^\s*[-*]?\s*:(?:param|parameter|arg|argument|key|keyword|type|var|ivar|cvar|raises?|except|exception|returns?|rtype|yields?|ytype)\b[^:]*:\s*", re.I),
    re.compile(r"^\s*@(?:param|arg|argument|prop|property|returns?|throws|exception|raises?|type|typedef|template|yields?|callback|default|since|version|author|example)\b\s*(?:\{[^}]*\})?\s*(?:\[[^\]]*\]|[\w$.]+(?=\s|$))?\s*(?:[-–:]\s*)?", re.I),
    re.compile(r"^\s*[-*]\s*(?:parameters?|returns?|throws|requires|precondition|complexity)\b\s*[\w$]*\s*:\s*", re.I),
    re.compile(r"^\s*[-*+]\s*`[^`]*`\s*(?:[-–:]\s*)?"),
    re.compile(r"^\s*(?:args?|arguments?|parameters?|params?|returns?|return value|return type|raises?|yields?|throws|attributes|see also|notes?|examples?|errors|panics|safety|input|inputs|output|outputs)\s*:\s*", re.I),
    re.compile(r"^\s*#+\s*(?:arguments?|parameters?|returns?|errors|panics|safety|examples?)\s*$", re.I),
    re.compile(r"^\s*\$\d\s*(?:[-–:]\s*)?"),
)
_RETURN_TAG = re.compile(r"^\s*(?:@returns?|@throws|@type|@yields?)\b\s*(?:\{[^}]*\})?\s*(?:[-–:]\s*)?", re.I)
_LABEL = re.compile(r"^\s*(?:[a-z]\w*_\w*|[a-z]+[A-Z]\w*|\w{1,24})\s*(?:\([^)]*\))?\s*:(?=\s|$)\s*")
_TOKEN = re.compile(r"[^\W\d_]+|\d+", re.U)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
#: Words that carry no statement: glue, and words for the thing itself.
_GLUE = frozenset(
    "a an the this that these those it its is are was be been of to for from in on at by with and or as into which who when then than "
    "function functions func fn method methods procedure routine helper helpers utility util class object implementation wrapper subroutine callback "
    "called named call calls used use uses using does do performs perform performing executes execute handles handle "
    "takes take taking accepts accept given gives gets get returns return returning returned gibt zurück "
    "parameter parameters param params argument arguments arg args value values type types result results input inputs output outputs no none any "
    "void null undefined optional required self cls main simple just here there "
    "async static public private def fun pub export const let var".split()
)
_KEEP = frozenset("null none any no".split())


@lru_cache(maxsize=100_000)
def _stem(w: str) -> str:
    w = w.lower()
    if len(w) > 4 and w.endswith("ies"):
        w = w[:-3] + "y"
    elif len(w) > 4 and w.endswith(("sses", "shes", "ches", "xes", "zes")):
        w = w[:-2]
    elif len(w) > 3 and w.endswith("s") and not w.endswith(("ss", "us", "is")):
        w = w[:-1]
    for end in ("ing", "ed"):
        if len(w) > len(end) + 3 and w.endswith(end):
            w = w[: -len(end)]
            if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "ls":
                w = w[:-1]
            break
    return w[:-1] if len(w) > 3 and w.endswith("e") else w


def _words(text: str) -> list[str]:
    return [w for t in _TOKEN.findall(text) for w in _CAMEL.split(t) if w]


def says_something(doc: str, name: str, signature: str | None) -> str | None:
    """The describing part of a documentation text (without markers), or None if there is none.

    Lines and sentences that are directives, placeholders, filler or references are left out, tags lose their names and
    types; then at least one word must remain that is not in the name, the signature or the glue. Names of the code, such as a
    type that the signature does not have, are no words.
    """
    text = bare(doc)
    if not text or _BANNER.search(text) and _is_banner(text):
        return None
    known = {_stem(w) for w in _words(name) + _words(signature or "")}
    kept: list[str] = []
    news = False
    for line in text.split("\n"):
        if not line.strip() or _DIRECTIVE.match(line) or _TODO.match(line) or _FILLER.match(line) or _REFERENCE.match(line):
            continue
        said = line
        m = _RETURN_TAG.match(said)
        if m:
            said = said[m.end() :]
        else:
            for tag in _TAGS:
                m = tag.match(said)
                if m:
                    said = said[m.end() :]
                    break
            else:
                m = _LABEL.match(said)
                if m and (not said[m.end() :].strip() or not m.group().strip().rstrip(":").isalpha() or m.group().strip().rstrip(":").lower() == name.lower()):
                    said = said[m.end() :]
        whole = False
        for sentence in re.split(r"(?<=[.!?;。])\s+", said):
            if not sentence.strip() or _DIRECTIVE.match(sentence) or _TODO.match(sentence) or _FILLER.match(sentence) or _REFERENCE.match(sentence):
                continue
            whole = True
            news = news or _news(sentence, known)
        if whole:
            kept.append(line.strip())
    return "\n".join(kept) if news else None


#: Names of the code, which are no words: with underscores, in camel case, or of several capitalised parts.
_NAME_LIKE = re.compile(r"\b(?:[A-Za-z0-9]+_\w+|_\w+|[a-z]+[A-Z]\w*|(?:[A-Z][a-z0-9]+){2,})\b")


def _news(sentence: str, known: set[str]) -> bool:
    plain = _NAME_LIKE.sub(" ", re.sub(r"\{@?\w+\s*[^}]*\}|<[^>]*>|https?://\S+", " ", sentence))
    for w in _words(plain):
        low = w.lower()
        if low.isdigit() or (len(low) == 1 and low.isascii()):
            continue
        if low in _GLUE and not (low in _KEEP and _stem(low) not in known and low == "null"):
            continue
        if low in known or _stem(low) in known:
            continue
        return True
    return False


def _is_banner(text: str) -> bool:
    """Whether a text that has a banner's words is one: most of its lines are, or its first sentence is."""
    lines = [x for x in text.split("\n") if _TOKEN.search(x)]
    hits = sum(bool(_BANNER.search(x)) for x in lines)
    return hits * 2 >= len(lines) or bool(_BANNER.search(lines[0]))


def _parameters(signature: str | None) -> list[tuple[str, str]]:
    """Name and type (empty if there is none) of the parameters in order, without defaults, receivers and blanks."""
    s = signature or ""
    a = s.find("(")
    if a < 0:
        return []
    depth, parts, cur, before = 0, [], "", ""
    for c in s[a + 1 :]:
        arrow = c == ">" and before in ("=", "-")
        if c in "([{<":
            depth += 1
        elif c in ")]}>" and not arrow:
            if depth == 0:
                break
            depth -= 1
        before = c
        if c == "," and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += c
    parts.append(cur)
    out = []
    for p in parts:
        p = p.strip().lstrip("&*.").removeprefix("mut ").strip()
        name = re.split(r"[:=]", p)[0].split(" ")[0].rstrip("?")
        if name and name not in ("self", "cls", "this"):
            rest = re.split(r"=(?!>)", p)[0][len(name) :].lstrip("?")
            rest = rest.split(":", 1)[1] if ":" in rest else rest
            out.append((re.sub(r"[^a-z0-9]", "", name.lower()), re.sub(r"\s+", "", rest.lower())))
    return out


def normal_signature(signature: str | None) -> str:
    """Parameter names of a signature in order, without types, defaults, receivers and blanks."""
    return ",".join(n for n, _ in _parameters(signature))


def parameter_types(signature: str | None) -> list[str]:
    """Types of the parameters that :func:`normal_signature` names, in lower case without blanks; empty where none is written."""
    return [t for _, t in _parameters(signature)]


def resolve(types: list[str], overloads: list[tuple[list[str], int, str | None]], name: str, signature: str | None) -> str | None:
    """The description of the declaration that a definition belongs to, among those of its name and parameter names.

    ``overloads`` are (types, id, documentation). The same types win, and a single declaration needs none; else types that are
    written on both sides must agree, and most agreeing ones win, the first that says something. The description is judged after that.
    """
    same = [o for o in overloads if list(o[0]) == types]
    if same or len(overloads) == 1:
        fit = same or overloads
    else:
        fits = [(sum(a == b != "" for a, b in zip(o[0], types)), o) for o in overloads if len(o[0]) == len(types) and all(a == b or not a or not b for a, b in zip(o[0], types))]
        most = max((n for n, _ in fits), default=0)
        fit = sorted((o for n, o in fits if n == most), key=lambda o: o[1])
    return next((said for o in fit if o[2] and (said := says_something(o[2], name, signature))), None)


def code_without(body: str, comment: str | None) -> str:
    return body.replace(comment, "", 1) if comment else body


OWN = "id bigint, space string, lang string, qual string, sig string, types array<string>, declared boolean, doc string, origin string, description string, code string, signature string, kind string, name string"


def own_documentation(symbols: DataFrame) -> DataFrame:
    """One row per distinct callable row with its own documentation, if it has any that says something; see :data:`OWN`."""
    rows = (
        symbols.select(
            F.col("id").cast("long").alias("id"), *[F.col(c).cast("string").alias(c) for c in ("name", "file_path", "signature", "docstring", "body", "language")], canonical_kind(F.col("kind")).alias("kind"), F.coalesce(F.col("is_stub").cast("boolean"), F.lit(False)).alias("is_stub")
        )
        .where(F.col("id").isNotNull() & F.col("kind").isin(*CALLABLE))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, name, path, sig, doc, body, lang, kind, stub in pdf[["id", "name", "file_path", "signature", "docstring", "body", "language", "kind", "is_stub"]].itertuples(index=False):
                name = name or ""
                blank = body is None or not body.strip()
                comment = None
                if doc is not None:
                    origin, text = "docstring", doc
                else:
                    comment = None if blank else comment_in_body(body, lang)
                    origin, text = "body", comment
                said = says_something(text, name, sig) if text else None
                low = (lang or "").strip().lower()
                declared = bool(stub) or blank
                out.append((i, (path or "").split("/", 1)[0], _FAMILY.get(low, low), name, normal_signature(sig), parameter_types(sig), declared, text if declared else None, origin if said else None, said, None if blank else code_without(body, comment), sig, kind, name))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OWN.split(", ")])

    return rows.mapInPandas(run, OWN)


PAIR_COLUMNS = ["id", "kind", "name", "signature", "code", "description", "origin"]


def pairs(symbols: DataFrame) -> DataFrame:
    """``id``, ``kind``, ``name``, ``signature``, ``code``, ``description``, ``origin`` of every documented function.

    ``origin`` is ``docstring``, ``body`` or ``declaration``. Rows without a real description, stubs, and rows whose body
    is null or blank give no pair. Of repeated rows of an id one is kept (ordered by code and description). An empty
    docstring is a documentation without words: the body is then not searched. Null names and signatures count as empty;
    extra columns are ignored.
    """
    own = materialize(own_documentation(symbols), "own")
    defs = own.where(~F.col("declared"))
    have = defs.where(F.col("description").isNotNull()).select(*PAIR_COLUMNS)
    # one row per declared name and parameter names, with its overloads: the join below is many to one, whatever is popular
    keys = ["space", "lang", "qual", "sig"]
    best = F.min_by("doc", F.struct(F.col("description").isNull(), F.col("doc").isNull(), "description", "doc"))
    decl = own.where("declared").groupBy(*keys, "types").agg(F.min("id").alias("first"), best.alias("doc")).groupBy(*keys).agg(F.collect_list(F.struct("types", "first", "doc")).alias("overloads"))
    lack = defs.where(F.col("description").isNull()).drop("description", "origin", "doc")
    both_sides = lack.join(decl, keys).select("id", "kind", "name", "signature", "code", "types", "overloads")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said = [resolve(list(t), [(list(o["types"]), o["first"], o["doc"]) for o in os], name, sig) for t, os, name, sig in pdf[["types", "overloads", "name", "signature"]].itertuples(index=False)]
            out = pdf[["id", "kind", "name", "signature", "code"]].assign(description=pd.Series(said, dtype=object, index=pdf.index), origin="declaration")
            yield out[out["description"].notna()]

    found = both_sides.mapInPandas(run, "id bigint, kind string, name string, signature string, code string, description string, origin string")
    both = have.unionByName(found)
    first = F.min_by(F.struct(*PAIR_COLUMNS[1:]), F.struct(F.col("origin") == "declaration", "code", "description"))
    return both.groupBy("id").agg(first.alias("x")).select("id", "x.*")


def documented(symbols: DataFrame) -> DataFrame:
    """``id`` of the functions with a real description of their own (docstring or body)."""
    return own_documentation(symbols).where(~F.col("declared") & F.col("description").isNotNull()).select("id").distinct()
