"""SQL of the modality rules: words as rows, with what follows them by window functions; the operator is an automaton."""

from __future__ import annotations

# Verbs that make a bare imperative.
VERBS = {
    "a to c": "act answer ask avoid be build bypass change check cite compromise consult create",
    "d to l": "delete deny design eliminate ensure escalate follow format ground implement include inspect keep leak",
    "m to r": "maintain mark modify pitch prefer preserve prioritize promise read rebuild reduce refactor refer reference reject republish rerun retreat return reveal rewrite run",
    "s to z": "signal skip structure suggest treat trust update use validate verify weaken wipe write",
}
#: Texts that the invented prose lacks: each rule at least once, and near misses.
SAMPLES = [
    "You must not share this.", "you really should answer", "You may leave. ", "you may not leave", "you can not", "you can go", "you must imagine it", "you must to imagine it", "you must to to imagine", "you one two three must", "You must", "you may", "you never not",
    "Always use tabs", "please do keep it", "Strictly follow it", "do not delete it", "never run it", "No exceptions", "No", "Don't forget it", "don't delete it", "The code must work", "Code must work", "the system must work", "All work shall be", "all the work must",
    "Code should be validated", "Code should be validate", "tests a b c must", "tests a b c d must", "ALLOC STRATEGY: arena", "alloc strategy: arena", "ALLOC STRATEGY", "EBPF MONITORING x: y", "ON FAIL -> stop", "ON A B C -> d", "ON A B C D -> e", "On FAIL -> stop", "ON -> x",
    "build: make all", "unit test", "lint step: go", "lint one step: go", "Every change must pass", "every a b c d e must", "every a b c d must", "Default requirement: every x", "default requirement: run x", "default requirement every x", "bid x is prohibited", "bid a b c d e forbidden", "bid a b c d e f forbidden",
    "If it fails, do not rerun", "if it fails, make sure to rerun", "if it fails, make sure rerun, check it", "if it fails then rerun", "if a, check it, do not run", "if a, do not check; run", "if a b c d e f g h i j k l m, run", "if a b c d e f g h i j k l m n o, run",
    "in the folder, run them", "in the folder,run them", ",run them", "nice but keep it", "but keep", "to get it going just check it", "to get it going. We check it", "to. get it going check it", "to get it going, then. It is so. We check it", "the tests are here and don't change it", "the tests. are here check",
    "if you hit a wall check", "if you need, x: ask", "The design goal is: preserve rules", "the design purpose is: to get it. preserve", "x the design goal is: keep", "the design goal is keep", "You are a helper", "you speak", "Now you ask", "then we use it", "é.run it", "a\nrun", "a\r\n\t run", "", "1. run", "(run", "K.use",
]


def _any(words: str) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words.split()) + ")"


def masks_sql(rows: str, keep: str) -> str:
    """(keep, modality_mask) of the texts of a relation with a column ``text``; ``keep`` tells its rows apart."""
    verb = _any(" ".join(VERBS.values()))
    behind = lambda n: ", ".join(f"lead(low, {i}) OVER p AS w{i}, lead(g, {i}) OVER p AS g{i}, lead(up, {i}) OVER p AS u{i}, coalesce(lead(low, {i}) OVER p IN {verb}, false) AS v{i}" for i in range(1, n + 1))
    duty = "must shall required"
    within = lambda words, n: " OR ".join(f"w{i} IN {_any(words)}" for i in range(1, n + 1))
    scoped = " OR ".join(f"(w{i} IN {_any(duty)} OR (w{i} = 'should' AND w{i + 1} = 'be' AND v{i + 2}))" for i in range(1, 5))
    caps = lambda n: " AND ".join(f"u{i}" for i in range(1, n + 1))
    arrow = " OR ".join(f"({caps(n)} AND contains(g{n + 1}, '->'))" for n in (1, 2, 3))
    fields = [("ALLOC", "STRATEGY"), ("CONCURRENCY", "MODEL"), ("PERFORMANCE", "TARGET"), ("ANTI", "VM"), ("SANDBOX", "AWARE"), ("EBPF", "MONITORING")]
    o = {
        "identity": "start AND low = 'you' AND w1 IN ('are', 'speak', 'reference', 'ask')",
        "label": f"start AND low IN {_any('build test lint benchmarks production development')} AND (contains(g1, ':') OR contains(g2, ':'))",
        "field": f"start AND up AND u1 AND contains(g2, ':') AND ({' OR '.join(f'''(low = '{a.lower()}' AND w1 = '{b.lower()}')''' for a, b in fields)})",
        "arrow": f"start AND up AND low = 'on' AND ({arrow})",
        "every": f"start AND low = 'every' AND ({within(duty + ' should', 5)})",
        "adverb": "start AND low IN ('always', 'please', 'strictly') AND v1",
        "default": "start AND low = 'default' AND w1 = 'requirement' AND contains(g2, ':') AND (v2 OR w2 = 'every')",
        "forget": "start AND low = 'don' AND w1 = 't' AND w2 = 'forget'",
        "verb": "start AND v AND NOT meta",
        "scoped": f"start AND (low IN {_any('functions code logic tests work')} OR (low = 'the' AND w1 = 'system') OR (low = 'all' AND w1 = 'work')) AND ({scoped})",
        "lead": "lead AND v AND NOT meta",
        "then": "thens AND v",
        "but": "b1 = 'but' AND v",
        "comma": "b1 IS NOT NULL AND v AND ends_with(g, ',')",
        "if": "start AND low = 'if' AND told = 2",
    }
    f = {
        "do": "start AND low = 'do' AND w1 = 'not' AND v2",
        "never": "start AND low = 'never' AND v1",
        "no": "start AND low = 'no' AND w1 IS NOT NULL",
        "bid": f"start AND low = 'bid' AND ({within('prohibited forbidden', 6)})",
        "don": "lead AND low = 'don' AND w1 = 't' AND v2",
        "if": "start AND low = 'if' AND told = 4",
    }
    modal = "you <= 3 AND low <> 'you' AND NOT coalesce(w1 IN ('imagine', 'picture', 'envision', 'suppose') OR (w1 = 'to' AND w2 IN ('imagine', 'picture', 'envision', 'suppose')), false)"
    o["modal"] = f"{modal} AND ((low IN {_any(duty)} AND w1 IS DISTINCT FROM 'not') OR low = 'should')"
    f["modal"] = f"{modal} AND ((low IN {_any(duty + ' may can')} AND w1 = 'not') OR low IN ('never', 'cannot'))"
    p = f"{modal} AND low = 'may' AND w1 IS DISTINCT FROM 'not'"
    either = lambda rules: "coalesce(bool_or(" + " OR ".join(f"coalesce({r}, false)" for r in rules) + "), false)"
    return rf"""SELECT {keep}, CASE WHEN {either(o.values())} THEN 2 ELSE 0 END + CASE WHEN {either(f.values())} THEN 4 ELSE 0 END + CASE WHEN {either([p])} THEN 8 ELSE 0 END AS modality_mask FROM (
      SELECT *, first_value(consequent IGNORE NULLS) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING) AS told,
        coalesce(max(leads) OVER (PARTITION BY r, sentence ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS lead,
        coalesce(max(opens) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS thens FROM (
        SELECT *, CASE WHEN low = 'then' AND coalesce(max(leads) OVER (PARTITION BY r, sentence ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 1 ELSE 0 END AS opens,
          i - max(CASE WHEN low = 'you' THEN i END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS you,
          CASE WHEN clause AND low = 'make' AND w1 = 'sure' AND w2 = 'to' AND v3 THEN 2 WHEN clause AND low = 'do' AND w1 = 'not' AND v2 THEN 4 WHEN clause AND v THEN 2 END AS consequent,
          b4 = 'the' AND b3 = 'design' AND b2 IN ('goal', 'purpose') AND b1 = 'is' AND contains(g, ':') AS meta FROM (
          SELECT *, coalesce(low IN {verb}, false) AS v, sum(stop::INT) OVER (PARTITION BY r ORDER BY i) AS sentence,
            CASE WHEN (low = 'get' AND b1 = 'to') OR (low IN ('need', 'hit') AND b1 = 'you' AND b2 = 'if') OR (low = 'tests' AND b1 = 'the' AND w1 = 'are') THEN 1 ELSE 0 END AS leads FROM (
            SELECT *, {behind(6)}, lag(low, 1) OVER p AS b1, lag(low, 2) OVER p AS b2, lag(low, 3) OVER p AS b3, lag(low, 4) OVER p AS b4 FROM (
              SELECT r, {keep}, i, w, lower(w) AS low, regexp_full_match(w, '[A-Z]+') AS up, g, regexp_matches(g, CASE WHEN i = 1 THEN '(^|[\n.!?:;])[ \t\r]*$' ELSE '[\n.!?:;][ \t\r]*$' END) AS start,
                regexp_matches(g, CASE WHEN i = 1 THEN '(^|[\n.])[ \t\r]*$' ELSE '[\n.][ \t\r]*$' END) AS stop, i > 1 AND regexp_matches(g, '[,;:][ \t\r\n]*$') AS clause FROM (
                SELECT r, {keep}, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w, unnest(gs[1:len(ws)]) AS g FROM (
                  SELECT row_number() OVER () AS r, {keep}, regexp_extract_all(text, '[A-Za-z]+') AS ws, regexp_split_to_array(text, '[A-Za-z]+') AS gs FROM {rows})))
            WINDOW p AS (PARTITION BY r ORDER BY i)))))
      RIGHT JOIN (SELECT {keep} FROM {rows}) a USING ({keep}) GROUP BY ALL"""
