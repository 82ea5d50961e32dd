"""Scores: bands, final scores, comparisons, ledgers, risk and what repeated scorings allow.

A ledger is a struct of hiring_thesis, centrals (requirement, classification, grade, evidence), narrative_coherence,
misclassification_check, compounding_applied, band_setter, band, score and the four semantic flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .text import blank, col, has, lookup, strip

EDGES = list(vocab.BANDS.values())[1:]
GRADE_RANK = {g: i for i, g in enumerate(vocab.GRADES)}
#: How far two passes may be apart to agree, and from where they materially differ.
ACCEPT, MATERIAL = 5, 10


def compacted(*rules: tuple[Column, object]) -> Column:
    """The messages of the rules that hold, in order."""
    said = [F.when(F.coalesce(c, F.lit(False)), m if isinstance(m, Column) else F.lit(m)) for c, m in rules]
    return F.array_compact(F.array(*said))


def band_of(score) -> Column:
    out = None
    for name, least in reversed(vocab.BANDS.items()):
        out = F.when(col(score) >= least, name) if out is None else out.when(col(score) >= least, name) if least else out.otherwise(name)
    return F.when(col(score).isNotNull(), out)


def normalize_band(band) -> Column:
    return strip(F.regexp_replace(F.coalesce(col(band), F.lit("")), "[‒–—−]", "-"))


def band_index(band) -> Column:
    return lookup(normalize_band(band), {b: str(i) for i, b in enumerate(vocab.BANDS)}).cast("int")


def bands_adjacent(a, b) -> Column:
    return F.coalesce(F.abs(band_index(a) - band_index(b)) == 1, F.lit(False))


def crosses_edge(a, b) -> Column:
    lo, hi = F.least(col(a), col(b)), F.greatest(col(a), col(b))
    crossed = F.exists(F.array(*[F.lit(e) for e in EDGES]), lambda e: (lo < e) & (e <= hi))
    return F.coalesce(F.when(col(a).isNotNull() & col(b).isNotNull(), crossed), F.lit(False))


def final_score(desire, market, style, practicality, weights: dict[str, float] | None = None) -> Column:
    """The weighted sum in this order, halves to the even number; null if one is missing."""
    w = vocab.WEIGHTS | (weights or {})
    parts = [F.lit(w[k]) * col(c).cast("double") for k, c in (("desire", desire), ("market", market), ("style", style), ("practicality", practicality))]
    return F.bround(parts[0] + parts[1] + parts[2] + parts[3]).cast("long")


def first_status(final) -> Column:
    out = None
    for least, status in vocab.FIRST_STATUS.items():
        out = F.when(col(final) >= least, status) if out is None else out.when(col(final) >= least, status)
    return F.when(col(final).isNotNull(), out.otherwise(vocab.LAST_STATUS))


def score_band(score) -> Column:
    """One of eight bands of a part's score."""
    c = col(score)
    out = F.when(c >= 85, "85+")
    for lo, hi in ((80, 84), (75, 79), (70, 74), (65, 69), (60, 64), (50, 59)):
        out = out.when(c >= lo, f"{lo}-{hi}")
    return F.when(c.isNotNull(), out.otherwise("<50"))


def final_band(score) -> Column:
    c = col(score)
    return F.when(c >= 80, "80+").when(c >= 70, "70-79").when(c >= 60, "60-69").when(c.isNotNull(), "<60")


def delta_band(delta) -> Column:
    c = col(delta)
    return F.when(c >= 30, "30+").when(c >= 15, "15-29").when(c >= 5, "5-14").when(c >= 0, "0-4")


def whole(text) -> Column:
    """A whole number, or null for anything else."""
    s = strip(text)
    return F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("long"))


def comparison_errors(base, improved, delta, why) -> Column:
    """What is wrong with a block of base score, improved score, their difference and its reason."""
    names = ["base", "improved", "delta"]
    raw = [strip(F.coalesce(col(c).cast("string"), F.lit(""))) for c in (base, improved, delta)]
    b, i, d = n = [whole(r) for r in raw]
    bad = [(r != "") & v.isNull() for r, v in zip(raw, n)]
    any_bad = bad[0] | bad[1] | bad[2]
    given = [(r != "").cast("int") for r in raw]
    count = given[0] + given[1] + given[2]
    whole_block = ~any_bad & (count == 3)
    rules = [(x, f"{k} is not a whole number") for x, k in zip(bad, names)]
    rules.append((~any_bad & count.isin(1, 2), "half-written"))
    for k, v in (("base", b), ("improved", i)):
        rules += [(whole_block & ~v.between(0, 100), f"{k} outside 0-100"), (whole_block & (v % 5 != 0), f"{k} not a multiple of 5")]
    rules += [
        (whole_block & (i < b), "improved below base"), (whole_block & (d != i - b), "delta is not improved - base"),
        (whole_block & (d < 0), "delta negative"), (whole_block & (d % 5 != 0), "delta not a multiple of 5"),
        (whole_block & blank(why), "reason missing"),
    ]
    return compacted(*rules)


def thesis_defining(ledger) -> Column:
    return F.filter(F.coalesce(col(ledger)["centrals"], F.array()), lambda c: c["classification"] == "thesis-defining")


def grade_rank(g) -> Column:
    return lookup(g, {k: str(v) for k, v in GRADE_RANK.items()}).cast("int")


def weakest_grade(ledger) -> Column:
    """The lowest grade of what the thesis needs, unknown ones last; null without any."""
    ranked = F.transform(thesis_defining(ledger), lambda c: F.struct(F.coalesce(grade_rank(c["grade"]), F.lit(9)).alias("r"), c["grade"].alias("g")))
    return F.array_min(ranked)["g"]


def ledger_errors(ledger) -> Column:
    """Why a ledger is incomplete; empty if it is complete."""
    led = col(ledger)
    fields = ["hiring_thesis", "narrative_coherence", "misclassification_check", "band_setter", "band"]
    rules = [(led[f].isNull() | (led[f] == ""), f"missing {f}") for f in fields]
    rules += [(led[f].isNull(), f"missing {f}") for f in ("compounding_applied", "score")]
    rules.append((F.coalesce(F.size(led["centrals"]) <= 0, F.lit(True)), "centrals empty"))
    centrals = F.coalesce(led["centrals"], F.array())
    for f in ("requirement", "classification", "grade", "evidence"):
        rules.append((F.exists(centrals, _lacks(f)), f"central without {f}"))
    rules.append((F.exists(centrals, lambda c: ~F.coalesce(c["grade"].isin(vocab.GRADES), F.lit(False))), "central with unknown grade"))
    rules.append((F.exists(centrals, lambda c: F.length(strip(c["requirement"])) < 4), "central with short requirement"))
    for f in ("hiring_thesis", "band_setter"):
        rules.append((F.length(strip(led[f])) < 12, f"{f} too short"))
    rules.append((led["score"].isNotNull() & (F.coalesce(led["band"], F.lit("")) != "") & (band_of(led["score"]) != normalize_band(led["band"])), "band differs from score"))
    return compacted(*rules)


def _lacks(f: str):
    return lambda c: c[f].isNull() | (c[f] == "")


def deterministic_flags(ledger, prior=None, prior_status=None, lo=None, hi=None, expected_band=None) -> Column:
    """Flags that follow from the structured fields alone."""
    led = col(ledger)
    s, td = led["score"], thesis_defining(ledger)
    null = F.lit(None)
    prior, prior_status, lo, hi, expected_band = (null if x is None else col(x) for x in (prior, prior_status, lo, hi, expected_band))
    empty = lambda c: c["grade"].isin("direct", "transferable") & F.lower(strip(c["evidence"])).isin("", "cannot name", "n/a", "none")
    centrals = F.coalesce(led["centrals"], F.array())
    return compacted(
        (F.exists(td, lambda c: c["grade"] == "absent"), "absent_thesis_central"),
        (F.exists(td, lambda c: c["grade"] == "light") & (s < 68), "light_thesis_central_sub68"),
        (led["compounding_applied"], "compounding"),
        ((s < 68) & (F.size(F.filter(centrals, lambda c: c["grade"] == "direct")) >= 2), "sub68_despite_directs"),
        (F.abs(s - prior.cast("long")) >= 10, "big_move_vs_prior"),
        (F.exists(centrals, empty), "positive_grade_without_evidence"),
        (blank(led["band_setter"]), "missing_band_setter"),
        (prior_status == "carried", "carried_replaced_by_fresh"),
        ((s < lo.cast("long")) | (s > hi.cast("long")), "calibration_anchor_violation"),
        (s.isNotNull() & (led["band"] != expected_band.cast("string")), "calibration_band_violation"),
    )


def semantic_flags(ledger) -> Column:
    return compacted(*[(col(ledger)[f], f) for f in vocab.SEMANTIC_FLAGS])


def edge_modifier(ledger, prior, flags: Column) -> Column:
    """Within three of an edge and across it from the prior score, where no other flag is up."""
    s = col(ledger)["score"]
    near = F.exists(F.array(*[F.lit(e) for e in EDGES]), lambda e: F.abs(s - e) <= 3)
    return F.coalesce((F.size(flags) == 0) & near & crosses_edge(s, col(prior)), F.lit(False))


def acceptance(primary, second, same_thesis, same_setter, same_narrative) -> Column:
    """accept_primary, flag_adjudication, require_adjudication, or fail_incomplete for two passes over one posting."""
    p, s = col(primary), col(second)
    thesis, setter, narrative = (F.coalesce(col(c), F.lit(False)) for c in (same_thesis, same_setter, same_narrative))
    spread = F.coalesce(F.abs(p["score"] - s["score"]), F.lit(999))
    bp, bs = band_of(p["score"]), band_of(s["score"])
    same_band, adjacent = F.coalesce(bp == bs, F.lit(False)), bands_adjacent(bp, bs)
    gp, gs = weakest_grade(p), weakest_grade(s)
    apart = F.coalesce(F.abs(F.coalesce(F.when(gp.isNotNull(), F.coalesce(grade_rank(gp), F.lit(0)))) - F.when(gs.isNotNull(), F.coalesce(grade_rank(gs), F.lit(0)))), F.lit(9))
    compounding = ~F.coalesce(p["compounding_applied"], F.lit(False)).eqNullSafe(F.coalesce(s["compounding_applied"], F.lit(False)))
    agree = thesis & gp.eqNullSafe(gs) & setter & narrative & ~compounding
    material = (spread > MATERIAL) | (apart > 1) | compounding | ~thesis | ~setter | ~(same_band | adjacent)
    return (
        F.when(F.size(ledger_errors(p)) > 0, "fail_incomplete").when((spread <= ACCEPT) & (same_band | adjacent) & agree, "accept_primary")
        .when(material, "require_adjudication").otherwise("flag_adjudication")
    )


def anchor_status(ledger, score, anchor) -> Column:
    """pass, range_violation (only the score is off) or reasoning_mismatch. anchor: a struct of expected values."""
    led, a, s = col(ledger), col(anchor), col(score)
    got = weakest_grade(led)
    allowed = a["expected_pivotal_grade_allowed"]
    listed = F.coalesce(F.size(allowed) > 0, F.lit(False))
    wrong_grade = F.when(listed, ~F.coalesce(F.array_contains(allowed, got), F.lit(False))).otherwise(F.coalesce(~got.eqNullSafe(a["expected_pivotal_grade"]) & (a["expected_pivotal_grade"] != ""), F.lit(False)))
    floor = F.coalesce(grade_rank(a["min_thesis_defining_grade"]), F.lit(0))
    weak = F.exists(thesis_defining(led), lambda c: F.coalesce(grade_rank(c["grade"]), F.lit(0)) < floor)
    compounding = a["expected_compounding"].isNotNull() & (F.coalesce(led["compounding_applied"], F.lit(False)) != a["expected_compounding"])
    want = normalize_band(a["expected_band"])
    straddle = F.coalesce(a["boundary_straddle_allowed"], F.lit(False)) & bands_adjacent(band_of(s), want)
    band_off = (want != "") & (band_of(s) != want) & ~straddle
    lo = F.coalesce(a["operating_range_min"], F.get(a["accepted_range"], F.lit(0)))
    hi = F.coalesce(a["operating_range_max"], F.get(a["accepted_range"], F.lit(1)))
    off = F.coalesce((s < lo) | (s > hi), F.lit(False))
    mismatch = wrong_grade | weak | F.coalesce(compounding, F.lit(False)) | F.coalesce(band_off, F.lit(False))
    return F.when(mismatch, "reasoning_mismatch").when(off, "range_violation").otherwise("pass")


def fallback_completeness(pay, place) -> Column:
    p, w = strip(pay), strip(place)
    no_pay, no_place = (p == "") | F.contains(p, F.lit("?")), (w == "") | (F.lower(w) == "unknown")
    return F.when(no_pay & no_place, "⚠ comp+location not verified").when(no_pay, "⚠ comp not verified").when(no_place, "⚠ location unknown").otherwise("✓ complete")


def normalize_status(status) -> Column:
    """A tracker state in its exact spelling, found by its letters and digits; others stay as written."""
    raw = strip(status)
    table = {"".join(ch for ch in v.lower() if ch.isalnum()): v for v in vocab.TRACKER_STATUS}
    return F.coalesce(lookup(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", ""), table), raw)


def normalize_lane(lane) -> Column:
    s = F.trim(F.regexp_replace(F.coalesce(col(lane), F.lit("")), r"\s+", " "))
    shape = r"(?i)^(health|consumer|work tools|work|other)\s*[-–—]\s*(.+)$"
    bucket, what = F.lower(F.regexp_extract(s, shape, 1)), strip(F.regexp_extract(s, shape, 2))
    named = F.when(bucket == "work tools", "Work").otherwise(F.initcap(bucket))
    mental = (bucket == "health") & has(what, "(?i)mental health")
    return F.when(bucket != "", F.when(mental, "Health - Mental Health").otherwise(F.concat_ws(" - ", named, what))).when(F.lower(s) == "work tools", "Work").otherwise(s)


def completeness_valid(value) -> Column:
    """Whether a completeness text is made of known labels, joined by ; or ·."""
    known = r"^(✓ complete|⚠ (comp\+location|comp|location) (not verified|unknown|conflicting)|.*not posted.*)$"
    parts = F.transform(F.split(F.coalesce(col(value), F.lit("")), r"\s*[;·]\s*"), lambda p: strip(p))
    return F.forall(parts, lambda p: p.rlike(known))


def completeness_category(value) -> Column:
    v = F.coalesce(col(value), F.lit(""))
    return F.when(F.contains(v, F.lit("⚠")), "attention").when(F.contains(v, F.lit("not posted")), "benign").when(v.startswith("✓"), "complete").otherwise("attention")


def role_name(role) -> Column:
    """A role for names: PM, VP, Senior, no slash or colon, and one comma before a specialisation."""
    s = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(col(role), F.lit("")), r"\s+", " ")), r"\s*[/:]\s*", " "))
    head = F.regexp_extract(s, r"^(.*?)\s+[-–—]\s+(.*)$", 1)
    tail = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(s, r"^(.*?)\s+[-–—]\s+(.*)$", 2), r"\s+[-–—]\s+|,", " "), r"\s+", " "))
    s = F.when(head != "", F.when(tail != "", F.concat_ws(", ", head, tail)).otherwise(head)).otherwise(s)
    for pattern, to in ((r"(?i)\bSr\.?(?=[\s,]|$)", "Senior"), (r"(?i)\bProduct Manager\b", "PM"), (r"(?i)\bVice President\b", "VP"), (r"\s+", " ")):
        s = F.regexp_replace(s, pattern, to)
    s = strip(s, " ,")
    core = r"(?i)^((?:(?:Senior|Staff|Principal|Lead|Group|Associate|Junior|Founding) )*PM)\s+(.+)$"
    return F.when(~F.contains(s, F.lit(",")) & s.rlike(core), F.regexp_replace(s, core, "$1, $2")).otherwise(s)




def lane_fit(text) -> Column:
    """(lane, confidence, second) of a cell `Lane (high) · +Second`; blank where it says none."""
    shape = r"^(.+?)\s*\((high|medium|low)\)(?:\s*·\s*\+(.+))?$"
    return F.struct(*[F.regexp_extract(col(text), shape, i).alias(n) for i, n in enumerate(("lane", "confidence", "second"), 1)])


def refetch_status(status, unverified) -> Column:
    """(status, counted): rows with unverified content are marked to be fetched again, and no banner counts them."""
    bad = F.coalesce(col(unverified), F.lit(False))
    return F.struct(F.when(bad, "⚠️ NEEDS RE-FETCH").otherwise(col(status)).alias("status"), (~bad).alias("counted"))


def rubric_valid(score) -> Column:
    """A whole score of 1 to 5."""
    s = col(score)
    return s.between(1, 5) & (s == F.floor(s))
