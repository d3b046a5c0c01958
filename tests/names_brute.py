"""The flow over metric names again, in plain Python over all pairs: what tests hold the E queries against."""

import difflib
import re
from collections import Counter, defaultdict

from loam.operators.extract import metric_words
from loam.operators.normalize import BLOCKING, CONTEXT, DISAMBIGUATION, PROTECTED

WORD = re.compile(r"(?<![a-z0-9])(?:" + "|".join(metric_words()) + r")(?:e?s)?(?![a-z0-9])")


def clean(name):
    x = re.sub(r"\s+", " ", name or "", flags=re.A).strip(" ").rstrip("*†‡ ")
    return re.sub(r" *\([0-9]+\)+$", "", re.sub(r" *\[[0-9]+\]+$", "", x)).rstrip(" :;,.|/-")


def normal(name):
    return re.sub(" +", " ", re.sub(r"[^a-z0-9%/+& -]+", " ", clean(name).lower())).strip(" -:,.")


def words(name):
    return list(dict.fromkeys(re.findall("[a-z0-9]+", normal(name))))


def hinted(name):
    return bool(WORD.search(name.lower()))


def quality(name, n, decks):
    x = clean(name)
    if not x:
        return 0.0, ["empty_name"]
    low = x.lower()
    rules = [
        (re.fullmatch(r"[0-9.+% -]+", x), "numeric_only_name", 0.55),
        (re.fullmatch(r"fy\d{2,4}|q[1-4]|h[12]|\d{4}", low, re.A), "fiscal_or_year_name", 0.5),
        (re.search(r"[:=]\s*\$?[+-]?\d|\b\d+(\.\d+)?\s*(%|x\b|(min|minute|hr|hour|sec|second)s?\b)", low, re.A), "value_contamination", 0.38),
        (any(re.search(rf"\b{w}\b", low) for w in CONTEXT), "context_contamination", 0.14),
        (re.search("[a-z][A-Z]", name), "camel_glued_name", 0.08),
        (len(x) > 48, "name_too_long", 0.24),
        (len(re.findall("[a-z0-9]+", normal(name))) > 8, "too_many_tokens", 0.18),
        (not hinted(x), "missing_metric_hint", 0.06),
        (n == 1, "singleton_name", 0.1),
        (decks == 1, "single_deck_name", 0.06),
    ]
    hit = [(r, c) for yes, r, c in rules if yes]
    score = 0.78
    for _, c in hit:
        score -= c
    return min(1.0, max(0.0, score)), [r for r, _ in hit]


def label(text, most=120):
    parts = re.split("[:=]", text, maxsplit=1)
    if len(parts) == 2 and re.match("[0-9]", parts[1].lstrip(" \t$+-")) and 2 <= len(x := parts[0].strip(" ")) <= most:
        return x
    return None


def stats(rows):
    n, decks = Counter(), defaultdict(set)
    for r in rows:
        n[r["name"]] += 1
        decks[r["name"]].add(r["deck"])
    return {k: (n[k], len(decks[k])) for k in n}


def refined(rows, rounds=12):
    now = [{**r, "name": clean(r["name"]), "rounds": 0} for r in rows]
    for i in range(rounds):
        known, changed = stats(now), False
        for r in now:
            lines = [x for x in (label(t, 61) for t in (r["context"] or "").split("\n")) if x and re.match("[A-Za-z]", x)]
            options = [x for x in (label(r["name"]), lines[0] if lines else None) if x and hinted(x)]
            score, reasons = quality(r["name"], *known[r["name"]])
            bad = {"value_contamination", "numeric_only_name", "fiscal_or_year_name", "name_too_long"} & set(reasons)
            if bad and options and clean(options[0]) != r["name"] and score < 0.7:
                r["name"], r["rounds"], changed = clean(options[0]), i + 1, True
        if not changed:
            break
    return now


def similarity(a, b, units_a=(), units_b=()):
    na, nb, ta, tb = normal(a), normal(b), words(a), words(b)
    if not na or not nb or na == nb:
        return float(bool(na and nb))
    score = 0.55 * difflib.SequenceMatcher(a=na, b=nb).ratio() + 0.45 * len(set(ta) & set(tb)) / max(1, len(set(ta) | set(tb)))
    score += 0.05 * (len(ta) == len(tb) == 1 and ta[0][:3] == tb[0][:3]) + 0.04 * bool(set(units_a) & set(units_b)) + 0.03 * (hinted(a) and hinted(b))
    return min(1.0, max(0.0, score - 0.22 * any(bool(set(g) & set(ta)) != bool(set(g) & set(tb)) for g in DISAMBIGUATION)))


def similar(rows, threshold=0.86):
    units = defaultdict(set)
    for r in rows:
        units[r["name"]].add(r["unit"])
    names = sorted(units, key=str.encode)
    scored = ((a, b, round(similarity(a, b, units[a], units[b]), 6)) for i, a in enumerate(names) for b in names[i + 1 :])
    return [x for x in scored if x[2] >= threshold]


def clusters(pairs):
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b, _ in pairs:
        low, high = sorted((top(a), top(b)), key=str.encode)
        up[high] = low
    return {n: top(n) for n in list(up)}


def verdicts(rows, catalog):
    """(id, name, status, method, canonical_name, combined, validation, reasons) of each row; catalog: (name, unit, aliases)."""
    now = refined(rows)
    known, group, units = stats(now), clusters(similar(now)), defaultdict(set)
    for r in now:
        if r["name"] in group:
            units[group[r["name"]]].add(r["unit"])
    best: dict = {}
    for n, c in group.items():
        rank = (-known[n][0], not hinted(n), len(clean(n)), clean(n).lower().encode(), n.encode())
        best[c] = min(best.get(c, (rank, n)), (rank, n))
    keys: dict = {}
    for name, unit, aliases in sorted(catalog, key=lambda x: x[0], reverse=True):
        keys.update({a.lower(): (name, unit, "alias") for a in aliases})
    for name, unit, _ in sorted(catalog, key=lambda x: x[0], reverse=True):
        keys[name.lower()] = (name, unit, "exact")
    return [verdict(r, known, group, best, units, keys) for r in now]


def verdict(r, known, group, best, units, keys):
    name = r["name"]
    n, decks = known[name]
    q, reasons = quality(name, n, decks)
    own = group.get(name)
    to, conflict = (best[own][1], len(units[own]) > 1) if own is not None else (None, False)
    listed, sim = keys.get(name.lower()), similarity(name, to) if to is not None else 0.0
    blocked = bool(set(BLOCKING) & set(reasons))
    mismatch = bool(listed and listed[1] and r["unit"] and listed[1] != r["unit"])
    auto = False
    if to is not None:
        a, b = words(name), words(to)
        fits = sim >= 0.93 and max(len(a), len(b)) <= 6 and max(len(clean(name)), len(clean(to))) <= 40 and set(a) & set(PROTECTED) == set(b) & set(PROTECTED)
        auto = fits and q >= 0.7 and sim >= 0.95 and n >= 2 and decks >= 2 and not blocked and not conflict
    if {"numeric_only_name", "fiscal_or_year_name"} & set(reasons):
        status, method, result, sure = "invalid_name", "quality_gate", name, max(0.0, q - 0.12)
    elif listed:
        status, method, result = "needs_review" if mismatch else "catalog_mapped", f"catalog_{listed[2]}", listed[0]
        sure = min(1.0, (0.98 if listed[2] == "exact" else 0.94) * (0.85 + 0.15 * q)) - 0.08 * mismatch
    elif to is not None:
        status, method, result = "cluster_auto" if auto else "cluster_review", "cluster", to
        sure = min(1.0, min(1.0, 0.74 * sim + 0.26 * q) + 0.04 * auto)
        sure = min(sure, 0.55) if blocked else sure
    else:
        status, method, result, sure = "needs_review", "unresolved", name, max(0.0, q - 0.22)
    if "value_contamination" in reasons:
        sure = min(sure, 0.45 if "singleton_name" in reasons else 0.5)
    combined = min(1.0, max(0.0, 0.62 * sure + 0.38 * r["extraction_confidence"]))
    invalid = status == "invalid_name"
    more = {"unit_mismatch_catalog": mismatch and not invalid, "low_cluster_similarity": method == "cluster" and sim < 0.9, "cluster_unit_conflict": method == "cluster" and conflict, "cluster_requires_review": status == "cluster_review", "unresolved_name": method == "unresolved"}
    every = reasons + [k for k, yes in more.items() if yes]
    validation = "fail" if invalid or combined < 0.6 else "warn" if combined < 0.8 or every else "pass"
    if not invalid and combined < 0.6:
        every.append("low_combined_confidence")
    return (r["id"], name, status, method, result, round(combined, 6), validation, ";".join(sorted(set(every))))
