"""Licence scans. Aho-Corasick automata find identifier tags and notice phrases in one pass over a text each;
a shunting-yard parser turns the expression behind a tag into postfix order, which is then evaluated.

Null and empty texts have no words and no labels. Equal texts get equal rows; rows are judged one by one,
so ties, repeated rows, repeated or null doc_ids, columns of any other names and empty tables need no rule of their own."""

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame

from .common import map_texts, words_of

# Notice phrases and their labels; the first three are the base.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 3 clause": "bsd",
    "bsd 2 clause": "bsd",
    "isc license": "isc",
    "cc by sa": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}
# Where an expression begins.
TAGS = ("spdx-license-identifier:", "license-expression:")
# Beginnings of identifiers and the labels they stand for.
IDENTIFIERS = {
    "mit": "mit", "apache-2": "apache-2", "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by": "cc-by", "cc0": "cc0",
    "gpl-2": "gpl-2", "gpl-3": "gpl-3", "lgpl": "lgpl", "agpl": "agpl-3", "mpl": "mpl-2", "bsd": "bsd", "isc": "isc",
    "unlicense": "unlicense",
}
# How freely a text under each label may be used again; OTHER for identifiers that are not listed.
FREEDOM = {
    "mit": 1.0, "isc": 1.0, "bsd": 1.0, "cc0": 1.0, "unlicense": 1.0, "apache-2": 0.95, "cc-by": 0.9, "mpl-2": 0.7,
    "lgpl": 0.6, "cc-by-sa": 0.6, "gpl-2": 0.4, "gpl-3": 0.4, "agpl-3": 0.3, "cc-by-nc": 0.2, "reserved": 0.05,
}
OTHER = 0.5
# Operators bind in this order, the tightest last.
BINDING = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")


def well_formed(tokens: Iterable[str]) -> list[str]:
    """The longest beginning that is a well-formed expression, in one pass that ends at the first token out of place."""
    seen: list[str] = []
    depth, operand_next, long = 0, True, 0
    for token in tokens:
        if (token in BINDING or token == ")") == operand_next or token == ")" and not depth:
            break
        seen.append(token)
        depth += (token == "(") - (token == ")")
        operand_next = token in BINDING or token == "("
        if not operand_next and not depth:
            long = len(seen)
    return seen[:long]


def postfix(expression: str) -> list[str] | None:
    """The expression in postfix order; None if it is no well-formed expression."""
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for token in TOKEN.findall(expression.lower()):
        if token in BINDING:
            if operand_next:
                return None
            while held and BINDING.get(held[-1], 0) >= BINDING[token]:
                out.append(held.pop())
            held.append(token)
            operand_next = True
        elif token == ")":
            if operand_next:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif not operand_next:
            return None
        elif token == "(":
            held.append(token)
        else:
            out.append(token)
            operand_next = False
    if operand_next or "(" in held:
        return None
    return out + held[::-1]


def label_of(identifier: str) -> str:
    return next((IDENTIFIERS[k] for k in sorted(IDENTIFIERS, key=len, reverse=True) if identifier.startswith(k)), identifier)


def evaluate(order: list[str]) -> tuple[set[str], float]:
    """Labels named by a postfix expression, and the freedom it leaves: the best of alternatives (or), the worst
    of what holds together (and); an exception (with) takes half of what the licence withholds away."""
    stack: list[tuple[set[str], float]] = []
    for token in order:
        if token in BINDING:
            (b, y), (a, x) = stack.pop(), stack.pop()
            stack.append((a | b, max(x, y)) if token == "or" else (a | b, min(x, y)) if token == "and" else (a, (1 + x) / 2))
        else:
            label = label_of(token)
            stack.append(({label}, FREEDOM.get(label, OTHER)))
    return stack[0]


def expressions(text: str, ends: list[int]) -> list[tuple[set[str], float]]:
    """What the tags that end at those places say. Up to the line's end; where the whole is not well formed, the
    longest beginning that is."""
    out, line_end = [], -1
    for end in ends:
        if line_end <= end:
            line_end = text.find("\n", end + 1)
            line_end = len(text) if line_end < 0 else line_end
        tokens = well_formed(m[0] for m in TOKEN.finditer(text, end + 1, line_end))
        if tokens and (order := postfix(" ".join(tokens))):
            out.append(evaluate(order))
    return out


def scan_licences(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and
    n_expressions. score: the freedom that all notices and expressions leave together, 0 where there is none."""

    def make():
        import ahocorasick

        phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for k, label in (BASE_PHRASES | PHRASES).items():
            phrases.add_word(f" {k} ", (k in BASE_PHRASES, label, len(k) + 1))
        for k in TAGS:
            tags.add_word(k, k)
        phrases.make_automaton()
        tags.make_automaton()

        def scan(texts):
            rows = []
            for text in texts:
                words = words_of(text)
                line = f" {b' '.join(words).decode('latin-1')} "
                starts, base, found, freedom, at, before = [], set(), set(), [], 0, 0
                for end, (is_base, label, length) in phrases.iter(line):
                    found.add(label)
                    freedom.append(FREEDOM[label])
                    if is_base:
                        base.add(label)
                        here = end - length  # words before it, counted on from the hit before
                        before += line.count(" ", at, here) if here >= at else -line.count(" ", here, at)
                        at = here
                        starts.append(before)
                raw = (text or b"").decode("latin-1").lower()
                read = expressions(raw, [end for end, _ in tags.iter(raw)])
                for labels, free in read:
                    found |= labels
                    freedom.append(free)
                join = lambda x: ",".join(sorted(x))
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), join(base), join(found), min(freedom, default=0.0), len(read)))
            return list(map(list, zip(*rows, strict=True)))

        return scan

    return map_texts(docs, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_expressions long", make)
