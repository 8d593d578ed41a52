"""Column expressions over text: pattern dialect, match positions, redaction, hashes.

Everything here is built from Spark SQL functions and stays in the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark import fixed_values as fv
from auditspark.functions.needles import needles
from auditspark.functions.starts import quick


def jre(pattern: str) -> str:
    """The pattern as Spark runs it: only ``\\n`` ends a line, classes are Unicode."""
    return "(?dU)" + quick(pattern)


def ascii_jre(pattern: str) -> str:
    """The same for plain ASCII text, where classes and cases mean the same without Unicode tables."""
    return "(?d)" + quick(pattern)


def _run(text: Column | Doc, pattern: str, use) -> Column:
    """*use*(pattern) in the dialect that fits the text."""
    if not isinstance(text, Doc):
        return use(jre(pattern))
    return F.when(text.ascii, use(ascii_jre(pattern))).otherwise(use(jre(pattern)))


@dataclass(frozen=True)
class Doc:
    """A text, whether it is plain ASCII, and which of some literals it holds, found in one scan of its lower-case form."""

    text: Column
    ascii: Column
    hits: Column
    literals: tuple[str, ...] = ()
    wanted: set[str] = field(default_factory=set)

    @staticmethod
    def columns(text: Column, literals: tuple[str, ...]) -> list[Column]:
        """_ascii and _hits: the literals of the text. Of those that begin at one place the longest is listed, which tells of the others."""
        found = F.regexp_extract_all(F.lower(text), F.lit(f"(?=({any_of(literals)}))"), F.lit(1)) if literals else F.array().cast("array<string>")
        return [(F.length(text) == F.octet_length(text)).alias("_ascii"), F.array_distinct(found).alias("_hits")]


FEW = 6


def any_of(words) -> str:
    """The words as one pattern that shares their beginnings and prefers the longest."""
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        parts = [re.escape(c) + written(child) for c, child in sorted(node.items()) if c]
        if not parts:
            return ""
        if len(parts) > FEW:  # one test of a character passes over a handful of beginnings
            firsts = [re.escape(c) for c in sorted(node) if c]
            parts = [f"(?=[{''.join(firsts[i:i + FEW])}])(?:{'|'.join(parts[i:i + FEW])})" for i in range(0, len(parts), FEW)]
        return f"(?:{'|'.join(parts)})?" if "" in node else parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return written(tree)


def let(value: Column, use) -> Column:
    """*use*(value) with the value computed once; a column that is named twice inside a lambda is computed twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def holds(text: Column, literals) -> Column:
    """Whether the text holds one of the literals: much cheaper than a pattern that needs one of them."""
    found = F.lit(False)
    for literal in literals:
        found = found | text.contains(literal)
    return found


def raw(text: Column | Doc) -> Column:
    return text.text if isinstance(text, Doc) else text


def may_match(text: Column | Doc, pattern: str) -> Column | None:
    """A cheap test that is true for every text the pattern matches; None when there is none.

    Lower-casing is exact for ASCII only, so any other text passes.
    """
    wanted = needles(pattern) if isinstance(text, Doc) else None
    if not wanted:
        return None
    text.wanted.update(wanted)
    telling = [h for h in text.literals if h.startswith(wanted)]
    if not telling:
        return ~text.ascii
    # one folded literal instead of a column for each word
    return ~text.ascii | F.arrays_overlap(text.hits, F.split(F.lit("\x01".join(telling)), "\x01"))


def matches(text: Column | Doc, pattern: str) -> Column:
    found = _run(text, pattern, raw(text).rlike)
    guard = may_match(text, pattern)
    return found if guard is None else guard & found


def count(text: Column | Doc, pattern: str) -> Column:
    guard = may_match(text, pattern)
    n = _run(text, pattern, lambda p: F.regexp_count(raw(text), F.lit(p)))
    return n if guard is None else F.when(guard, n).otherwise(F.lit(0))


def first_index(text: Column | Doc, pattern: str) -> Column:
    """1-based position of the first match, 0 when there is none."""
    return _run(text, pattern, lambda p: F.regexp_instr(raw(text), F.lit(p)))


def all_matches(text: Column | Doc, pattern: str, group: int = 0) -> Column:
    found = _run(text, pattern, lambda p: F.regexp_extract_all(raw(text), F.lit(p), F.lit(group)))
    guard = may_match(text, pattern)
    return found if guard is None else F.when(guard, found).otherwise(F.array().cast("array<string>"))


def extract(text: Column | Doc, pattern: str, group: int) -> Column:
    return _run(text, pattern, lambda p: F.regexp_extract(raw(text), p, group))


def newlines(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\n"))


def first_line(text: Column | Doc, pattern: str) -> Column:
    """Line number of the first match (call only where there is one)."""
    return (newlines(F.substring(raw(text), F.lit(1), first_index(text, pattern) - 1)) + 1).cast("int")


ROWS = "array<struct<line:int,column:int,offset:int,value:string>>"


def match_rows(text: Column | Doc, pattern: str) -> Column:
    """Array of (line, column, offset, value) for every match, empty when there is none.

    Lines and columns count from 1, offsets from 0. Positions come from the lengths of the pieces
    between matches, so a match costs one running sum and no copy of the text before it; the lines
    of a piece are counted once. The pattern must not match the empty string.
    """
    found = F.regexp_extract_all(raw(text), F.lit(jre(pattern)), F.lit(0))
    pieces = F.split(raw(text), jre(pattern), -1)

    def measured(piece: Column) -> Column:
        return let(F.split(piece, "\n", -1), lambda rows: F.struct(
            (F.size(rows) - 1).alias("n"), F.length(F.element_at(rows, -1)).alias("last"), F.length(piece).alias("size")))

    steps = let(found, lambda all_found: F.zip_with(
        F.slice(pieces, F.lit(1), F.size(all_found)), all_found,
        lambda p, m: F.struct(measured(p).alias("p"), measured(m).alias("m"), m.alias("value"))))
    start = F.struct(
        F.lit(1).alias("line"), F.lit(0).alias("col"), F.lit(0).alias("pos"), F.array().cast(ROWS).alias("out"))

    def after(line: Column, col: Column, piece: Column) -> tuple[Column, Column]:
        return line + piece["n"], F.when(piece["n"] > 0, piece["last"]).otherwise(col + piece["size"])

    def fold(acc, x):
        line, col = after(acc["line"], acc["col"], x["p"])
        pos = acc["pos"] + x["p"]["size"]
        row = F.struct(line.alias("line"), (col + 1).alias("column"), pos.alias("offset"), x["value"].alias("value"))
        line2, col2 = after(line, col, x["m"])
        return F.struct(line2.alias("line"), col2.alias("col"), (pos + x["m"]["size"]).alias("pos"),
                        F.concat(acc["out"], F.array(row)).alias("out"))

    return F.when(matches(text, pattern), F.aggregate(steps, start, fold, lambda acc: acc["out"])).otherwise(
        F.array().cast(ROWS))


def redacted_token(token: Column) -> Column:
    return F.concat(
        F.substring(token, 1, fv.REDACT_PREFIX), F.lit("…[REDACTED:"),
        F.substring(F.sha2(token, 256), 1, fv.REDACT_HASH), F.lit("]"))


def redact(text: Column, pattern: str = fv.SECRET) -> Column:
    """Replace every credential-shaped token; text without one passes through untouched.

    Pieces between matches are kept and every match is replaced in its own place, so a token
    that is a prefix of another one cannot damage it.
    """
    def glued(found: Column) -> Column:
        return let(F.split(text, jre(pattern), -1), lambda pieces: F.concat(
            F.array_join(F.zip_with(
                F.slice(pieces, F.lit(1), F.size(found)), found,
                lambda p, m: F.concat(p, redacted_token(m))), ""),
            F.element_at(pieces, -1)))

    return F.when(matches(text, pattern), let(all_matches(text, pattern), glued)).otherwise(text)


def normalized(text: Column) -> Column:
    """Whitespace runs become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text, jre(r"\s+"), " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, jre(r"^\s+|\s+$"), "")


def snippet(text: Column) -> Column:
    """A finding's text as it is stored, uncut; sinks shorten what they show."""
    return text


def amount_text(amount: Column) -> Column:
    """A number as plain digits with at least one decimal, where a cast would use an exponent from ten million on."""
    digits = F.rtrim(amount.cast("decimal(38,10)").cast("string"), F.lit("0"))
    return F.when((F.abs(amount) >= 1e7) & (F.abs(amount) < 1e16), F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)).otherwise(
        amount.cast("string"))


def entropy(token: Column) -> Column:
    """Bits per character."""
    def bits(t: Column) -> Column:
        n = F.length(t).cast("double")
        parts = F.transform(
            F.array_sort(F.array_distinct(F.split(t, ""))),
            lambda c: (n - F.length(F.replace(t, c, F.lit("")))) / n)
        return F.when(n > 0, F.aggregate(parts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))).otherwise(F.lit(0.0))

    return let(token, bits)


def finding_fingerprint(rule: Column, path: Column, context: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", rule, path, context), 256), 1, 16)


def entity_id(path: Column, symbol: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", path, symbol), 256), 1, 12)


def with_text(df: DataFrame, name: str, build, content: str = "content") -> DataFrame:
    """*df* with column *name*, built from a Doc of its text.

    The literals of all patterns that *build* asks for are looked for in one scan; then only patterns whose literals are
    there run, as compiled columns. The column comes out of a generator, so that a filter on it is not
    moved below, where everything would be computed again.
    """
    doc = Doc(F.col(content), F.col("_ascii"), F.col("_hits"))
    build(doc)
    literals = tuple(sorted(doc.wanted))
    scanned = df.select("*", *Doc.columns(F.col(content), literals))
    built = scanned.withColumn("_built", build(Doc(F.col(content), F.col("_ascii"), F.col("_hits"), literals)))
    return built.select(*df.columns, F.explode(F.array("_built")).alias(name))


def flags(text: Column | Doc, patterns: dict[str, str]) -> Column:
    """Sorted names of the patterns found in the text."""
    return F.array_compact(F.array(*[
        F.when(matches(text, patterns[name]), F.lit(name)) for name in sorted(patterns)]))


def gitignore_regex(pattern: str) -> str:
    """One ignore-file pattern as an anchored regular expression over a relative path."""
    body = pattern.rstrip()
    if body.startswith("\\") and body[1:2] in "#!":
        body = body[1:]
    only_dirs = body.endswith("/")
    body = body.rstrip("/") if only_dirs else body
    anchored = "/" in body.strip("/") or body.startswith("/")
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.+", i + 3
        elif body[i] == "*":
            while body.startswith("*", i):
                i += 1
            out += "[^/]*"
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 1:]:
            end = body.index("]", i + 1)
            inner = body[i + 1:end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]", end + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    head = "^" if anchored else "^(?:.*/)?"
    tail = "/.*$" if only_dirs else "(?:/.*)?$"
    return head + out + tail


def ignored_by(path: Column, patterns: list[str]) -> Column:
    """Whether an ordered ignore list drops the path; the last matching pattern decides.

    Neighbouring patterns of one polarity become one alternation.
    """
    runs: list[tuple[bool, list[str]]] = []
    for raw_line in patterns:
        line = raw_line.rstrip("\n")
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        negated = line.startswith("!")
        if not runs or runs[-1][0] != negated:
            runs.append((negated, []))
        runs[-1][1].append(gitignore_regex(line[1:] if negated else line))
    decision = F.lit(False)
    for negated, regexes in runs:
        decision = F.when(path.rlike("|".join(f"(?:{r})" for r in regexes)), F.lit(not negated)).otherwise(decision)
    return decision
