"""DuckDB text of the Student-t p-value and quantile used by the oracle SQL."""

STEPS = 400


def _simpson(a: str, b: str, nu: str) -> str:
    return (f"(list_sum(list_transform(range(0, {STEPS + 1}), lambda i: "
            f"(CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * "
            f"pow(greatest(cos(({a}) + i * (({b}) - ({a})) / {STEPS}), 0), ({nu}) - 1))) "
            f"* ((({b}) - ({a})) / {STEPS}) / 3)")


def p_two_sided(t: str, nu: str) -> str:
    th = f"atan(abs({t}) / sqrt({nu}))"
    cut = f"least(pi() / 2, 14 / sqrt({nu}))"
    return (f"((CASE WHEN {th} >= {cut} THEN 0 ELSE {_simpson(th, cut, nu)} END) / "
            f"{_simpson('0', cut, nu)})")


def t_quantile(prob: float, nu: str) -> str:
    target = 2 * (1 - prob)
    mid = "((acc.lo + acc.hi) / 2)"
    return (f"(list_reduce(range(1, 51), lambda acc, k: CASE WHEN {p_two_sided(mid, nu)} > {target!r} "
            f"THEN {{'lo': {mid}, 'hi': acc.hi}} ELSE {{'lo': acc.lo, 'hi': {mid}}} END, "
            f"{{'lo': 0.0::DOUBLE, 'hi': 50.0::DOUBLE}}) AS bis)")


def effect_label(d: str) -> str:
    return (f"CASE WHEN abs({d}) < 0.2 THEN 'Negligible' WHEN abs({d}) < 0.5 THEN 'Small' "
            f"WHEN abs({d}) < 0.8 THEN 'Medium' WHEN abs({d}) < 1.2 THEN 'Large' ELSE 'Very Large' END")
