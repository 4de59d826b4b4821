"""The suffix stripping of ``functions.stemming`` as steps of SQL over distinct tokens."""

from __future__ import annotations

from passageloom.functions.stemming import IRREGULAR, STEP_2, STEP_3, STEP_4


def _shape(word: str) -> str:
    """``c`` and ``v`` for each letter; y is a vowel after a consonant."""
    letter = "CASE WHEN x IN ('a', 'e', 'i', 'o', 'u') OR (x = 'y' AND right(s, 1) = 'c') THEN 'v' ELSE 'c' END"
    return f"list_reduce([''] || string_split({word}, ''), lambda s, x: s || CASE WHEN x = '' THEN '' ELSE {letter} END)"


def _measure(shape: str) -> str:
    return f"len(regexp_extract_all({shape}, 'v+c+'))"


def _short_end(stem: str, shape: str) -> str:
    return f"((ends_with({shape}, 'cvc') AND right({stem}, 1) NOT IN ('w', 'x', 'y')) OR {shape} = 'vc')"


def _cut(n: int | str, word: str = "w") -> str:
    return f"left({word}, length({word}) - {n})"


def _first(cases: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in cases) + f" ELSE {otherwise} END"


def _ends(suffix: str, word: str = "w") -> str:
    return f"ends_with({word}, '{suffix}')"


def stem_steps(tokens: str) -> list[str]:
    """CTEs from ``tokens``, a query of distinct ``token``, to ``stems(token, stem)``."""
    steps: list[str] = []
    last = "stem_tokens"
    steps.append(f"stem_tokens AS MATERIALIZED (SELECT token, token AS w FROM ({tokens}))")

    def step(word: str, suffix: str | None = None) -> None:
        """A new ``w``; with ``suffix`` (a length) the expression may use ``st`` and its shape ``sh``."""
        nonlocal last
        name = f"stem_{len(steps)}"
        source = last
        if suffix is not None:
            source = f"(SELECT *, {_shape('st')} AS sh FROM (SELECT token, w, cut, {_cut('cut')} AS st FROM (SELECT token, w, {suffix} AS cut FROM {last})))"
        steps.append(f"{name} AS MATERIALIZED (SELECT token, {word} AS w FROM {source})")
        last = name

    short = lambda few: f"CASE WHEN length(w) = 4 THEN {_cut(1)} ELSE {_cut(2)} END" if few else _cut(1)
    step(_first([(_ends("sses"), _cut(2)), (_ends("ies"), short(True)), (f"{_ends('s')} AND NOT {_ends('ss')}", _cut(1))], "w"))
    # Past and progressive forms.
    double = "(length(st) > 1 AND right(st, 1) = substr(st, -2, 1) AND ends_with(sh, 'c'))"
    tidy = _first(
        [
            ("regexp_matches(st, '(at|bl|iz)$')", "st || 'e'"),
            (double, f"CASE WHEN right(st, 1) IN ('l', 's', 'z') THEN st ELSE {_cut(1, 'st')} END"),
            (f"{_measure('sh')} = 1 AND {_short_end('st', 'sh')}", "st || 'e'"),
        ],
        "st",
    )
    step(
        _first(
            [
                (_ends("ied"), short(True)),
                (_ends("eed"), f"CASE WHEN {_measure('sh')} > 0 THEN {_cut(1)} ELSE w END"),
                ("cut = 0 OR NOT contains(sh, 'v')", "w"),
            ],
            tidy,
        ),
        _first([(_ends("eed"), "3"), (_ends("ing"), "3"), (_ends("ed"), "2")], "0"),
    )
    step(f"CASE WHEN cut = 1 AND length(w) > 2 AND ends_with(sh, 'c') THEN st || 'i' ELSE w END", _first([(_ends("y"), "1")], "0"))
    step(f"CASE WHEN cut = 4 AND {_measure('sh')} > 0 THEN {_cut(2)} ELSE w END", _first([(_ends("alli"), "4")], "0"))
    for rules, special in ((STEP_2, True), (STEP_3, False)):
        by_length = sorted(rules, key=len, reverse=True)
        cases = [(_ends(s), str(len(s))) for s in by_length]
        values = [(_ends(s), f"st || '{rules[s]}'") for s in by_length]
        if special:
            # After "logi" only the last letter goes, and three are cut for the measure.
            cases.insert(0, (_ends("logi"), "3"))
            values.insert(0, (_ends("logi"), _cut(1)))
        step(f"CASE WHEN cut > 0 AND {_measure('sh')} > 0 THEN {_first(values, 'w')} ELSE w END", _first(cases, "0"))
    by_length = sorted(STEP_4, key=len, reverse=True)
    step(
        f"CASE WHEN cut = 0 OR {_measure('sh')} < 2 OR ({_longest_is('ion', by_length)} AND NOT regexp_matches(st, '[st]$')) THEN w ELSE st END",
        _first([(_ends(s), str(len(s))) for s in by_length], "0"),
    )
    step(
        f"CASE WHEN cut = 1 AND ({_measure('sh')} > 1 OR ({_measure('sh')} = 1 AND NOT {_short_end('st', 'sh')})) THEN st ELSE w END",
        _first([(_ends("e"), "1")], "0"),
    )
    step(f"CASE WHEN cut = 1 AND {_measure('sh')} > 1 THEN st ELSE w END", _first([(_ends("ll"), "1")], "0"))
    fixed = _first([(f"token = '{w}'", f"'{s}'") for w, s in IRREGULAR.items()] + [("length(token) <= 2", "token")], "w")
    steps.append(f"stems AS MATERIALIZED (SELECT token, {fixed} AS stem FROM {last})")
    return steps


def _longest_is(suffix: str, by_length: list[str]) -> str:
    longer = [s for s in by_length if s.endswith(suffix) and s != suffix]
    return " AND ".join([_ends(suffix), *(f"NOT {_ends(s)}" for s in longer)])
