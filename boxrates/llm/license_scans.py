"""License scans: identifier tags and notice phrases, and the value of license expressions.

One Aho-Corasick automaton finds the notice phrases in the words of a text, another finds
identifier tags in the text itself. The expression behind a tag is parsed by the
shunting-yard method (with over and over or) and evaluated to the sets of licenses that
each satisfy it, or kept as it is where those would be very many.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Base phrases and their labels.
BASE = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Further notice phrases and their labels.
NOTICES = {
    "affero general public license": "agpl",
    "bsd license": "bsd",
    "boost software license": "bsl",
    "cc by": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "eclipse public license": "epl",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "public domain": "public-domain",
    "unlicense": "unlicense",
}

# Tags before an expression.
TAGS = ["spdx-license-identifier:", "license-expression:"]

# Families of identifiers, by their beginning, longest first.
FAMILIES = [
    ("cc-by-nc", "cc-by-nc"),
    ("cc-by-sa", "cc-by-sa"),
    ("unlicense", "unlicense"),
    ("apache-", "apache"),
    ("cc-by", "cc-by"),
    ("agpl-", "agpl"),
    ("lgpl-", "lgpl"),
    ("bsd-", "bsd"),
    ("bsl-", "bsl"),
    ("epl-", "epl"),
    ("gpl-", "gpl"),
    ("mpl-", "mpl"),
    ("cc0", "cc0"),
    ("isc", "isc"),
    ("mit", "mit"),
]

#: Confidence that a text carries a license, by kind of evidence.
TAG_SCORE, PHRASE_SCORE = 0.95, 0.6

_OPERATORS = {"or": 1, "and": 2, "with": 3}
_LEXEME = re.compile(r"[A-Za-z0-9.+:-]+|[()]|\n|\S")
#: What may close a line after an expression, as ends of comments do.
_CLOSING = re.compile(r"[*/\-#> \t\r]*(?:\n|\Z)")
#: Expressions with more alternatives are not written out; see ``Unexpanded``.
MAX_ALTERNATIVES = 256


def _is_operand(lexeme: str) -> bool:
    return lexeme.isascii() and lexeme[0].isalnum()


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: the expression's operands and operators in postfix order.

    None if it is not well-formed.
    """
    out, stack, operand_due = [], [], True
    for lexeme in _LEXEME.findall(expression):
        word = lexeme.lower()
        if word in _OPERATORS:
            if operand_due:
                return None
            while stack and stack[-1] != "(" and _OPERATORS[stack[-1]] >= _OPERATORS[word]:
                out.append(stack.pop())
            stack.append(word)
            operand_due = True
        elif lexeme == "(":
            if not operand_due:
                return None
            stack.append(lexeme)
        elif lexeme == ")":
            if operand_due:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif not operand_due or not _is_operand(lexeme):
            return None
        else:
            out.append(word)
            operand_due = False
    if operand_due or "(" in stack:
        return None
    return out + stack[::-1]


class Unexpanded(list):
    """All licenses of an expression, sorted; ``order`` is the expression in postfix order.

    It stands for the alternatives of an expression that has too many to write out.
    """

    def __init__(self, licenses: set[str], order: list[str]):
        super().__init__(sorted(licenses))
        self.order = order

    def satisfied_by(self, held: set[str]) -> bool:
        """Whether the licenses ``held`` satisfy the expression, every choice considered."""
        stack: list[tuple[bool, str]] = []
        for item in self.order:
            if item not in _OPERATORS:
                stack.append((item in held, item))
                continue
            right, left = stack.pop(), stack.pop()
            if item == "with":
                name = f"{left[1]} with {right[1]}"
                stack.append((name in held, name))
            else:
                # Both sides of a license under WITH are that license.
                value = left[0] or right[0] if item == "or" else left[0] and right[0]
                stack.append((value, left[1]))
        return stack[0][0]


def evaluate(expression: str) -> list[list[str]] | None:
    """The alternatives that satisfy an expression, each a sorted list of licenses.

    ``A or B`` offers either's, ``A and B`` needs one of each together, and ``A with E`` is
    the license ``A with E``. An expression in which an ``and`` has more than
    ``MAX_ALTERNATIVES`` gives one ``Unexpanded``, which holds all of them. None if the
    expression is not well-formed.
    """
    order = postfix(expression)
    if order is None:
        return None
    # Alternatives (None if they are too many) and all licenses of each operand.
    stack: list[tuple[set[frozenset[str]] | None, set[str]]] = []
    for item in order:
        if item not in _OPERATORS:
            stack.append(({frozenset([item])}, {item}))
            continue
        (right, names), (left, all_names) = stack.pop(), stack.pop()
        if item == "with":
            if any(v is None or len(v) != 1 or len(min(v)) != 1 for v in (left, right)):
                return None
            (a,), (b,) = min(left), min(right)
            stack.append(({frozenset([f"{a} with {b}"])}, {f"{a} with {b}"}))
            continue
        all_names |= names
        if left is None or right is None:
            value = None
        elif item == "or":
            left |= right
            value = left
        elif len(left) * len(right) > MAX_ALTERNATIVES:
            value = None
        else:
            value = {a | b for a in left for b in right}
        stack.append((value, all_names))
    value, names = stack[0]
    return [Unexpanded(names, order)] if value is None else sorted(sorted(a) for a in value)


def _leading(text: str, start: int, plain: bool = False) -> str | None:
    """The longest well-formed expression from ``start`` on within its line.

    It ends before the first lexeme that can't continue it, and without full stops, colons
    and hyphens behind its last identifier. None if there is none, or if the line ends
    where more of the expression is due. With ``plain``, ``with`` takes identifiers only.
    """
    begin = end = before = None
    depth, operand_due = 0, True
    for found in _LEXEME.finditer(text, start):
        lexeme, word = found[0], found[0].lower()
        begin = found.start() if begin is None else begin
        if _CLOSING.match(text, found.start()):
            return None if operand_due or depth else text[begin:end]
        if word in _OPERATORS:
            if operand_due or (plain and word == "with" and before == ")"):
                break
            operand_due = True
        elif lexeme == "(":
            if not operand_due or (plain and before == "with"):
                break
            depth += 1
        elif lexeme == ")":
            if operand_due or not depth:
                break
            depth -= 1
        elif not operand_due or not _is_operand(lexeme):
            break
        else:
            operand_due = False
        if not operand_due and not depth:
            end = found.start() + len(lexeme.rstrip(".:-"))
        before = word
    else:
        if operand_due or depth:
            return None
    return None if end is None else text[begin:end]


def leading_expression(text: str, start: int = 0) -> tuple[str, list[list[str]]] | None:
    """The expression that begins at ``start`` of a text, whatever follows it, and its value."""
    for plain in (False, True):
        expression = _leading(text, start, plain)
        value = None if expression is None else evaluate(expression)
        if value is not None:
            return expression, value
    return None


def family(license_id: str) -> str:
    """The label of an identifier; an unknown identifier is its own label."""
    plain = license_id.partition(" with ")[0]
    for start, label in FAMILIES:
        if plain.startswith(start):
            return label
    return plain.replace(",", " ")


@functools.cache
def _phrases():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE}.items():
        automaton.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE))
    automaton.make_automaton()
    return automaton


@functools.cache
def _tags():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for tag in TAGS:
        automaton.add_word(tag, tag)
    automaton.make_automaton()
    return automaton


def scan(text: str) -> dict:
    """What one text says of licenses; see ``licenses``."""
    lower = text.encode().lower().decode()  # of bytes, which lowers A-Z only
    words = WORD.findall(lower)
    line = f" {' '.join(words)} "
    places, base, labels = [], set(), set()
    for end, (length, label, is_base) in _phrases().iter(line):
        labels.add(label)
        if is_base:
            base.add(label)
            places.append(line.count(" ", 0, end - length + 1))
    tagged, expressions = False, []
    for end, _ in _tags().iter(lower):
        found = leading_expression(text, end + 1)
        if found is not None:
            expression, value = found
            tagged = True
            expressions.append(expression)
            labels.update(family(x) for choice in value for x in choice)
    miss = (1 - TAG_SCORE if tagged else 1.0) * (1 - PHRASE_SCORE) ** min(len(labels), 3)
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(labels)),
        "expressions": expressions,
        "score": 1.0 - miss if labels else 0.0,
    }


SCHEMA = T.StructType(
    [
        *[T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")],
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("expressions", T.ArrayType(T.StringType())),
        T.StructField("score", T.DoubleType()),
    ]
)


@F.pandas_udf(SCHEMA)
def _scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = pd.DataFrame([scan(t or "") for t in batch], columns=SCHEMA.names)
        for name in ("first_word", "last_word"):
            rows[name] = rows[name].astype("Int64")
        yield rows


def licenses(docs: DataFrame) -> DataFrame:
    """``doc_id`` and what each text says of licenses; one row per row of ``docs``.

    ``n_words``; ``n_base, first_word, last_word, base_labels`` of the base phrases (places
    in words from 0); ``labels`` of base phrases, further notices and tagged expressions;
    ``expressions`` as tagged; ``score`` as confidence that the text carries a license.

    - NULL and empty texts have no words and no labels, and score 0.
    - Behind a tag the longest well-formed expression counts, whatever follows it on the
      line; the first word there is an identifier in prose on tags, too. Tags without one,
      and expressions that the end of the line cuts short, are passed over.
    - Whole texts are scanned, whatever their length. Repeated rows give repeated results,
      other columns are ignored, and an empty table gives an empty table.
    """
    found = docs.select("doc_id", _scan(F.coalesce("text", F.lit(""))).alias("found"))
    return found.select("doc_id", "found.*")
