"""Finding a passage in a text and carrying its marks over: exact, fuzzy, in a given range, or from several sources in turn.

The functions on strings are plain Python, for pandas UDFs and tests; those on columns run them over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import align, documents
from tessella.session import stage

# What counts as one passage.
LEAST_BLOCK, LEAST_COVER = 8, 0.80
MOST_DRIFT = 24
STRETCH_BLOCK, STRETCH_GAP, STRETCH_SKEW, STRETCH_MATCHED, STRETCH_DENSITY = 3, 12, 8, 10, 0.7
MAP_RATIO, ACCEPTED = 0.75, 0.30
CHAPTER_MARKS = "○◎●卷"


def plain_ratio(a: str, b: str) -> float:
    """The standard matcher's ratio, which leaves characters out of account that are frequent in a long second text."""
    return SequenceMatcher(None, a, b).ratio()


def overlap(tape: str, passage: str) -> tuple[int, int] | None:
    """Where the passage lies in the tape: as it is, or where common runs along one diagonal cover enough of it. None if nowhere."""
    if not passage:
        return None
    at = tape.find(passage)
    if at >= 0:
        return at, at + len(passage)
    runs = align.common_runs(passage, tape)
    best, group = None, []
    for r in [*runs, None]:
        if r is not None and (not group or abs((r[1] - r[0]) - (group[-1][1] - group[-1][0])) <= MOST_DRIFT):
            group.append(r)
            continue
        if group:
            covered = sum(n for *_, n in group)
            if max(n for *_, n in group) >= min(LEAST_BLOCK, len(passage)) and covered >= LEAST_COVER * len(passage) and (best is None or covered > best[0]):
                best = (covered, group[0][1], group[-1][1] + group[-1][2])
        group = [r] if r is not None else []
    return best[1:] if best else None


def overlap_flexible(tape: str, passage: str) -> tuple[int, int] | None:
    """overlap, tried again behind each chapter mark of the passage."""
    found = overlap(tape, passage)
    for i, ch in enumerate(passage):
        if found:
            break
        if ch in CHAPTER_MARKS:
            found = overlap(tape, passage[i + 1 :])
    return found


def overlap_from(tape: str, passage: str, start: int) -> tuple[int, int] | None:
    found = overlap(tape[start:], passage)
    return None if found is None else (found[0] + start, found[1] + start)


def free_parts(start: int, end: int, covered: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of an interval the covered ones leave free, in order."""
    out, at = [], start
    for a, b in sorted(covered):
        if b <= at or a >= end:
            continue
        if a > at:
            out.append((at, a))
        at = max(at, b)
    return [*out, (at, end)] if at < end else out


def stretches(tape: str, passage: str, covered: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int, int, int]]:
    """(start, end, passage start, passage end) of the dense stretches of a tape that a passage matches and nothing covers yet."""
    out: list[tuple[int, int, int, int]] = []
    chain: list[tuple[int, int, int]] = []

    def close() -> None:
        if not chain:
            return
        a, b = chain[0][0], chain[-1][0] + chain[-1][2]
        p, q = chain[0][1], chain[-1][1] + chain[-1][2]
        matched = sum(n for *_, n in chain)
        if matched >= STRETCH_MATCHED and matched >= STRETCH_DENSITY * max(b - a, q - p):
            out.extend((x, y, p + x - a, q - (b - y)) for x, y in free_parts(a, b, covered))

    for run in align.common_runs(tape, passage):
        if run[2] < STRETCH_BLOCK and not chain:
            continue
        if chain:
            gap_a, gap_b = run[0] - chain[-1][0] - chain[-1][2], run[1] - chain[-1][1] - chain[-1][2]
            if max(gap_a, gap_b) > STRETCH_GAP or abs(gap_a - gap_b) > STRETCH_SKEW:
                close()
                chain = []
                if run[2] < STRETCH_BLOCK:
                    continue
        chain.append(run)
    close()
    return out


def place_map(passage: str, tape: str, strict: bool = True) -> dict[int, int]:
    """Places of the passage's characters in the tape: equal ones, and unless strict also those that stand for each other."""
    out: dict[int, int] = {}
    for kind, i1, i2, j1, j2 in SequenceMatcher(None, passage, tape, autojunk=False).get_opcodes():
        if kind == "equal" or (kind == "replace" and not strict):
            out |= {i1 + k: j1 + k for k in range(min(i2 - i1, j2 - j1))}
    return out


def trimmed_source(target_han: str, source: str) -> str:
    """The part of a source that reaches from the first to the last run it shares with the target."""
    han = "".join(documents._HAN.findall(source))
    runs = [r for r in align.common_runs(han, target_han) if r[2] >= STRETCH_BLOCK]
    return documents.han_range(source, runs[0][0], runs[-1][0] + runs[-1][2]) if runs else ""


def scoped_marks(source: str, target: str, least: float = MAP_RATIO) -> str:
    """target with the marks of source where enough of its characters stand there; a longer source is trimmed first, and too unlike a one changes nothing."""
    han = "".join(documents._HAN.findall(target))
    cut = trimmed_source(han, source)
    mapped = sum(n for *_, n in align.common_runs("".join(documents._HAN.findall(cut)), han))
    return documents.carried_marks(cut, target) if han and mapped >= least * len(han) else target


def from_sources(target: str, sources: Sequence[str]) -> tuple[str, float, list[int]]:
    """(text, share of Han characters covered, sources used): marks from each source in turn for what those before it left uncovered."""
    han = "".join(documents._HAN.findall(target))
    covered: list[tuple[int, int]] = []
    used: list[int] = []
    text = target
    for n, source in enumerate(sources):
        plain = "".join(documents._HAN.findall(source))
        found = stretches(han, plain, covered)
        if not found or sum(b - a for a, b, *_ in found) < ACCEPTED * min(len(han), len(plain)):
            continue
        for a, b, p, q in found:
            piece = documents.han_range(text, a, b)
            at = text.find(piece)
            if piece and at >= 0:
                text = text[:at] + documents.carried_marks(documents.han_range(source, p, q), piece) + text[at + len(piece) :]
        covered += [(a, b) for a, b, *_ in found]
        used.append(n)
    reach = sum(b - a for a, b in _union(covered))
    return (text if "".join(documents._HAN.findall(text)) == han else target), reach / len(han) if han else 0.0, used


def _union(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def grown_window(ref: str, keys: Sequence[str], anchor: int, most: int = 200, patience: int = 3) -> tuple[int, int, float]:
    """(first, last, score) of neighbouring units around the anchor that together match ref best; it grows to the better side, forward on ties, and goes back to the best after some steps without gain."""
    score = lambda a, b: _dice(ref, "".join(keys[a : b + 1]))
    first = last = anchor
    best = (anchor, anchor, score(anchor, anchor))
    idle = 0
    while idle < patience and last - first + 1 < most and (first > 0 or last < len(keys) - 1):
        ahead = score(first, last + 1) if last < len(keys) - 1 else -1.0
        back = score(first - 1, last) if first > 0 else -1.0
        if ahead >= back:
            last += 1
        else:
            first -= 1
        now = max(ahead, back)
        idle = 0 if now > best[2] else idle + 1
        best = (first, last, now) if now > best[2] else best
    return best


def _dice(a: str, b: str) -> float:
    return 2 * sum(n for *_, n in align.common_runs(a, b)) / (len(a) + len(b)) if a or b else 0.0


def align_paragraphs(ref: DataFrame, src: DataFrame, least: float = 0.85, top: int = 25, k: int = 5, most: int = 200) -> DataFrame:
    """(ref_id, file, first_idx, last_idx, score, kind) of the source units that hold each reference unit.

    ref: (ref_id, key); src: (src_id, file, idx, key). Equal keys first ('exact', the least src_id), then of the top
    candidates by shared k-grams the one of greatest containment ('contained'); where that falls short, or holds only part
    of the reference, neighbouring units of its file are joined to it ('merged'). What reaches least nowhere gives no row.
    """
    from tessella.operators.blocking import top_shared

    # keys are longer than the planner takes a text for, so it would broadcast them: hints keep them from the driver
    r, s = ref.where("length(key) > 0"), src.where("length(key) > 0")
    same = s.groupBy("key").agg(F.min_by(F.struct("file", "idx"), "src_id").alias("m"))
    exact = r.join(same.hint("merge"), "key").select("ref_id", "m.file", F.col("m.idx").alias("first_idx"), F.col("m.idx").alias("last_idx"), F.lit(1.0).alias("score"), F.lit("exact").alias("kind"))
    rest = r.join(exact.select("ref_id").hint("merge"), "ref_id", "left_anti")
    near = top_shared(rest, s, "ref_id", "key", "src_id", "key", k=k, top=top).select("ref_id", "src_id", "shared")
    held = near.join(rest.select("ref_id", F.col("key").alias("a")).hint("merge"), "ref_id").join(s.select("src_id", "file", "idx", F.col("key").alias("b")).hint("merge"), "src_id").withColumn("held", align.containment(F.col("a"), F.col("b")))
    best = stage(held.groupBy("ref_id", "a").agg(F.max_by(F.struct("file", "idx", "b", "held"), F.struct("held", "shared", -F.col("src_id"))).alias("m")).select("ref_id", "a", "m.*"), "aligned-best")
    whole = best.where((F.col("held") >= least) & (F.length("b") >= least * F.length("a")))
    contained = whole.select("ref_id", "file", F.col("idx").alias("first_idx"), F.col("idx").alias("last_idx"), F.col("held").alias("score"), F.lit("contained").alias("kind"))
    # the neighbours of the others, met in stretches of the file so that a long file is shared out
    open_ = best.join(contained.select("ref_id").hint("merge"), "ref_id", "left_anti").select("ref_id", "a", "file", "idx", F.explode(F.sequence(F.floor((F.col("idx") - most) / most), F.floor((F.col("idx") + most) / most))).alias("bin"))
    beside = s.select("file", F.col("idx").alias("i"), "key", F.floor(F.col("idx") / most).alias("bin"))
    around = open_.join(beside.hint("merge"), ["file", "bin"]).where(F.abs(F.col("i") - F.col("idx")) <= most).groupBy("ref_id", "a", "file", "idx").agg(F.sort_array(F.collect_list(F.struct("i", "key"))).alias("units"))

    def grow(a: str, idx: int, units: list) -> dict:
        places = [u["i"] for u in units]
        first, last, score = grown_window(a, [u["key"] for u in units], places.index(idx), most)
        return {"first_idx": places[first], "last_idx": places[last], "score": score}

    grown = around.select("ref_id", "file", documents._mapped("struct<first_idx:int,last_idx:int,score:double>", grow, F.col("a"), F.col("idx"), F.col("units")).alias("g"))
    merged = grown.select("ref_id", "file", "g.first_idx", "g.last_idx", "g.score", F.lit("merged").alias("kind")).where(F.col("score") >= least)
    return exact.unionByName(contained).unionByName(merged)


def located(tape: Column, passage: Column) -> Column:
    """struct<start,end> of a passage in a tape; null where it is not found or either is null."""
    return documents._mapped("struct<start:int,end:int>", lambda t, p: None if p is None or (x := overlap_flexible(t, p)) is None else {"start": x[0], "end": x[1]}, tape, passage)


def punctuated(target: Column, sources: Column) -> Column:
    """struct<text,covered,used> of a text with the marks of an array of sources in turn."""

    def run(t: str, ss: object) -> dict:
        text, covered, used = from_sources(t, [x for x in (ss if ss is not None else []) if x])
        return {"text": text, "covered": covered, "used": used}

    return documents._mapped("struct<text:string,covered:double,used:array<int>>", run, target, sources)
