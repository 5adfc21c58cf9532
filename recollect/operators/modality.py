"""Modality of instructions in text: obligation 2, forbidden 4, permitted 8.

A word is a run of ASCII letters. All rules are followed in one pass by an automaton over words: what a word is to the rules (most are
nothing to any) and what stands before it (``GAP`` flags) make a symbol; a state is the set of rules under way with what each waits for, together with
the lead-in of the sentence. Transitions are worked out when they are first met and then looked up, so a text costs one look-up a word.
Texts go to the workers in Arrow batches; a text's mask is the union of the rules that complete, and a text with a mask is promoted.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OBLIGATION, FORBIDDEN, PERMITTED = 2, 4, 8

# Verbs that make a bare imperative.
VERBS = frozenset(
    (
        "act answer ask avoid be build bypass change check cite compromise consult create delete deny design eliminate ensure escalate follow format ground implement include inspect keep leak maintain mark "
        "modify pitch prefer preserve prioritize promise read rebuild reduce refactor refer reference reject republish rerun retreat return reveal rewrite run signal skip structure suggest treat trust update use "
        "validate verify weaken wipe write"
    ).split()
)
# Subjects, labels and fields that make a rule of what follows.
SUBJECTS = frozenset(["functions", "code", "logic", "tests", "work"])
LABELS = frozenset(["build", "test", "lint", "benchmarks", "production", "development"])
FIELDS = {"ALLOC": "STRATEGY", "CONCURRENCY": "MODEL", "PERFORMANCE": "TARGET", "ANTI": "VM", "SANDBOX": "AWARE", "EBPF": "MONITORING"}
TALES = frozenset(["imagine", "picture", "envision", "suppose"])
DUTIES = frozenset(["must", "shall", "required"])
#: A modal near "you": its modality as it stands, and before "not".
MODALS = {**dict.fromkeys(DUTIES, (OBLIGATION, FORBIDDEN)), "should": (OBLIGATION, OBLIGATION), "may": (PERMITTED, FORBIDDEN), "never": (FORBIDDEN, FORBIDDEN), "cannot": (FORBIDDEN, FORBIDDEN), "can": (0, FORBIDDEN)}
#: What must follow a word at the start of a sentence, and the modality of both.
OPENERS = {**dict.fromkeys(["always", "please", "strictly"], ("VERB", OBLIGATION)), "never": ("VERB", FORBIDDEN), "do": ("not VERB", FORBIDDEN), "no": ("ANY", FORBIDDEN), "don": ("t forget", OBLIGATION)}
OTHER = frozenset("you are speak not to every default requirement forget if bid prohibited forbidden make sure do all the system t don but then get need hit goal purpose is on".split())
KNOWN = VERBS | SUBJECTS | LABELS | TALES | DUTIES | OTHER | frozenset(MODALS) | frozenset(OPENERS) | frozenset(x.lower() for p in FIELDS.items() for x in p)

#: What stands between two words: the second begins a sentence, or comes after a full stop or line break; a comma right before it; a clause mark as the
#: last sign; a colon or an arrow anywhere.
START, STOP, COMMA, CLAUSE, COLON, ARROW = (1 << i for i in range(6))
SPLIT = re.compile("([A-Za-z]+)")


def gap(between: str, first: bool) -> int:
    sentence, clause = between.rstrip(" \t\r"), between.rstrip(" \t\r\n")
    end, mark = sentence[-1:], clause[-1:]
    out = (START if end in "\n.!?:;" and (end or first) else 0) | (STOP if end in "\n." and (end or first) else 0)
    out |= (COMMA if between.endswith(",") else 0) | (CLAUSE if mark and mark in ",;:" else 0)
    return out | (COLON if ":" in between else 0) | (ARROW if "->" in between else 0)


class State(NamedTuple):
    """``rules``: (name, what is left to follow, further number or bits) of each rule under way; the rest is what came before."""

    rules: frozenset
    since_you: int = 9
    last: tuple[str, str] = ("", "")
    goal: int = 0
    lead: bool = False
    then: bool = False


GOAL = [("the",), ("design",), ("goal", "purpose"), ("is",)]


def _follows(state: State, word: str, caps: bool, before: int) -> tuple[set, int]:
    """The rules of a state after one more word, and the modality of those that it completes."""
    rules, mask = set(), 0
    verb, capital = word in VERBS, word.upper() if caps else ""
    for name, left, extra in state.rules:
        if name == "modal":  # extra: modality, that before "not", whether "to" was seen
            plain, negated, to = extra
            if word == "not" and not to:
                mask |= negated
            elif word == "to" and not to:
                rules.add((name, left, (plain, negated, True)))
            elif word not in TALES:
                mask |= plain
        elif name == "next":  # left: what must follow, word by word
            want, _, rest = left.partition(" ")
            if want == "ANY" or word == want or (want == "VERB" and verb):
                if rest:
                    rules.add((name, rest, extra))
                else:
                    mask |= extra
        elif name == "colon":  # a colon before this word, or (extra more times) before the next
            if before & COLON:
                mask |= OBLIGATION
            elif extra:
                rules.add((name, left, extra - 1))
        elif name == "field":
            if left == ":":
                mask |= OBLIGATION if before & COLON else 0
            elif capital == left:
                rules.add((name, ":", extra))
        elif name == "arrow":  # extra: capitals seen behind ON
            if extra and before & ARROW:
                mask |= OBLIGATION
            if caps and extra < 3:
                rules.add((name, left, extra + 1))
        elif name == "within":  # left: a set of words, extra: how far, modality
            far, bits = extra
            if word in _SETS[left]:
                mask |= bits
            elif far > 1:
                rules.add((name, left, (far - 1, bits)))
        elif name == "default":
            if left == "requirement":
                if word == left:
                    rules.add((name, ":", extra))
            elif before & COLON and (verb or word == "every"):
                mask |= OBLIGATION
        elif name == "scoped":  # left: the word that must come now, extra: how far a modal may still be
            if left and word != left:
                continue
            if word in DUTIES:
                mask |= OBLIGATION
            else:
                if word == "should":
                    rules.add(("next", "be VERB", OBLIGATION))
                if extra > 1:
                    rules.add((name, "", extra - 1))
        elif name == "if":
            rule, bits = _conditional(left, extra, word, verb, before)
            mask |= bits
            if rule:
                rules.add(rule)
    return rules, mask


def _conditional(left: str, extra: int, word: str, verb: bool, before: int) -> tuple[tuple | None, int]:
    """A condition, whose first clause of up to 14 words on that tells to do something decides. left: what such a clause still needs."""
    far = extra - 1
    if left:
        want, _, rest = left.partition(" ")
        if want == "VERB" and verb:
            return None, FORBIDDEN if rest == "F" else OBLIGATION
        if word == want:
            return ("if", rest, far), 0
    if far >= 0 and before & CLAUSE:
        if word == "make":
            return ("if", "sure to VERB O", far), 0
        if word == "do":
            return ("if", "not VERB F", far), 0
        if verb:
            return None, OBLIGATION
    return (("if", "", far) if far > 0 else None), 0


_SETS = {"duty": DUTIES | {"should"}, "ban": frozenset(["prohibited", "forbidden"])}


def step(state: State, word: str, caps: bool, before: int) -> tuple[State, int]:
    """The state after a word (in lower case; "" if it is nothing to any rule), and the modality of the rules that it completes."""
    lead = state.lead and not before & STOP
    rules, mask = _follows(state, word, caps, before)
    verb = word in VERBS
    meta = state.goal == len(GOAL) and bool(before & COLON)
    since = state.since_you + 1
    if word == "you":
        since = 0
        if before & START:
            rules |= {("next", x, OBLIGATION) for x in ("are", "speak", "reference", "ask")}
    elif since <= 3 and word in MODALS:
        rules.add(("modal", "", (*MODALS[word], False)))
    if before & START:
        if word in LABELS:
            rules.add(("colon", "", 1))
        if caps and word.upper() in FIELDS:
            rules.add(("field", FIELDS[word.upper()], 0))
        if caps and word == "on":
            rules.add(("arrow", "", 0))
        if word == "every":
            rules.add(("within", "duty", (5, OBLIGATION)))
        if word == "bid":
            rules.add(("within", "ban", (6, FORBIDDEN)))
        if word == "default":
            rules.add(("default", "requirement", 0))
        if word in OPENERS:
            rules.add(("next", *OPENERS[word]))
        if word == "if":
            rules.add(("if", "", 14))
        if verb and not meta:
            mask |= OBLIGATION
        if word in SUBJECTS:
            rules.add(("scoped", "", 4))
        if word in ("the", "all"):
            rules.add(("scoped", "system" if word == "the" else "work", 4))
    if verb and ((lead and not meta) or state.then or state.last[1] == "but" or (before & COMMA and state.last != ("", ""))):
        mask |= OBLIGATION
    if lead and word == "don":
        rules.add(("next", "t VERB", FORBIDDEN))
    then = state.then or (lead and word == "then")
    told = (word == "get" and state.last[1] == "to") or (word in ("need", "hit") and state.last == ("if", "you")) or (word == "are" and state.last == ("the", "tests") and not before & STOP)
    goal = state.goal + 1 if state.goal < len(GOAL) and word in GOAL[state.goal] else 1 if word == "the" else 0
    kept = word if word in ("to", "if", "you", "the", "tests", "but") else "-"
    return State(frozenset(rules), min(since, 9), (state.last[1] or "-", kept), goal, lead or told, then), mask


def ending(state: State) -> int:
    """Modality of what no further word can change: modals that wait for a "not"."""
    out = 0
    for name, _, extra in state.rules:
        out |= extra[0] if name == "modal" else 0
    return out


class Scanner:
    """The automaton, determinised as texts are read."""

    #: States that are kept; then it starts anew.
    MOST = 1 << 16

    def __init__(self):
        self._forget()
        self.gaps: dict[tuple[str, bool], int] = {}

    def _forget(self) -> None:
        self.states, self.numbers, self.next = [], {}, []
        self._number(State(frozenset()))

    def _number(self, state: State) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.next.append({})
        return self.numbers[state]

    def mask(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self.states) > self.MOST:
            self._forget()
        parts = SPLIT.split(text)
        at, out, gaps = 0, 0, self.gaps
        for i in range(1, len(parts), 2):
            between, raw = parts[i - 1], parts[i]
            before = 0 if between == " " else gaps.get((between, i == 1))
            if before is None:
                if len(gaps) > self.MOST:
                    gaps.clear()
                before = gaps[between, i == 1] = gap(between, i == 1)
            if i == 1 and between == " ":
                before = START | STOP
            low = raw.lower()
            symbol = (low if low in KNOWN else "", raw.isupper(), before)
            found = self.next[at].get(symbol)
            if found is None:
                state, bits = step(self.states[at], *symbol)
                found = self.next[at][symbol] = (self._number(state), bits)
            at, bits = found
            out |= bits
        return out | ending(self.states[at])


_scanner: Scanner | None = None


def scanner() -> Scanner:
    """One for each worker process."""
    global _scanner
    if _scanner is None:
        _scanner = Scanner()
    return _scanner


def mask(text: Column) -> Column:
    """The modality mask of a text; 0 for null."""

    @F.pandas_udf("int")
    def scanned(texts: pd.Series) -> pd.Series:
        s = scanner()
        return pd.Series([s.mask(t) for t in texts], dtype="int32")

    return scanned(text.cast("string"))
