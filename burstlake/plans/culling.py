"""Scans, pairing, per-photo features, group-relative scoring and routing."""

from __future__ import annotations

from .bursts import BURSTS_SQL, photo_bursts
from .dialect import Catalog, Dialect
from .rasters import CENTRE, WHOLE, Picture, detail, exposure_of, hash_bits, with_absolute, with_cells, with_gradients
from .views import BURSTS, IMAGE_LIST, RAW_LIST, features, files, photos, rgb

catalog = Catalog()
catalog.derived[BURSTS] = (photo_bursts, BURSTS_SQL)

# ---- scans and set operations -------------------------------------------------------------------------------------


@catalog.add
def photo_view(d: Dialect) -> str:
    return f"SELECT shot_id, folder, captured_at, round(aesthetic, 6) AS aesthetic, {d.total('gray')} AS gray_total FROM ({photos(d)})"


@catalog.add
def scan_filter_suffix(d: Dialect) -> str:
    return f"SELECT path, dir, stem, ext, length FROM ({files(d)}) WHERE lower(ext) IN ({RAW_LIST}, {IMAGE_LIST})"


@catalog.add
def scan_excluding_output(d: Dialect) -> str:
    rank = "row_number() OVER (PARTITION BY dir ORDER BY lower(path), path)"
    return f"SELECT path, {rank} AS place FROM ({files(d)}) WHERE dir <> '/vol3' AND lower(ext) IN ({RAW_LIST}, {IMAGE_LIST})"


@catalog.add
def companion_pairing(d: Dialect) -> str:
    """One shot per directory and case-blind stem; raw before ordinary images before others, then suffix, then path."""
    order = f"(CASE WHEN lower(ext) IN ({RAW_LIST}) THEN 0 ELSE 1 END), (CASE WHEN lower(ext) IN ({IMAGE_LIST}) THEN 0 ELSE 1 END), lower(ext), path"
    first = f"min_by(path, struct({order}))" if d.spark else f"arg_min(path, row({order}))"
    return f"SELECT dir, lower(stem) AS stem_key, {first} AS primary_path, count(*) AS files, sum(length) AS bytes FROM ({files(d)}) WHERE lower(ext) IN ({RAW_LIST}, {IMAGE_LIST}) GROUP BY dir, lower(stem)"


@catalog.add
def sidecar_lookup(d: Dialect) -> str:
    """Photos with the settings file of the same directory and case-blind stem, if there is one."""
    side = f"SELECT dir AS sdir, lower(stem) AS sstem, min(path) AS sidecar FROM ({files(d)}) WHERE lower(ext) = '.xmp' GROUP BY dir, lower(stem)"
    return f"SELECT path, sidecar FROM ({files(d)}) f LEFT JOIN ({side}) s ON f.dir = s.sdir AND lower(f.stem) = s.sstem WHERE lower(ext) IN ({RAW_LIST}, {IMAGE_LIST})"


@catalog.add
def first_wins_dedupe(d: Dialect) -> str:
    """Explicit paths, quotes and space stripped; the first of equal ones stays, in order."""
    asked = "SELECT event_id AS pos, concat('\"', event_type, CAST(user_id AS VARCHAR(20)), '\" ') AS raw FROM events"
    clean = f"SELECT pos, {d.sub('trim(raw)', '^[\"' + chr(39) * 2 + ']+|[\"' + chr(39) * 2 + ']+$', '')} AS path FROM ({asked})" if not d.spark else f"SELECT pos, regexp_replace(trim(raw), '^[\"]+|[\"]+$', '') AS path FROM ({asked})"
    return f"SELECT pos, path FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pos) AS n FROM ({clean})) WHERE n = 1"


@catalog.add
def input_expansion(d: Dialect) -> str:
    """Directories and files that were asked for: what each brings, and a failure row for what is not there."""
    asked = "SELECT DISTINCT concat('/vol', CAST(s_suppkey % 8 AS VARCHAR(20))) AS asked FROM supplier"
    found = f"SELECT dir, count(*) AS n FROM ({files(d)}) WHERE lower(ext) IN ({RAW_LIST}, {IMAGE_LIST}) GROUP BY dir"
    return f"SELECT asked, coalesce(n, 0) AS photos, CASE WHEN n IS NULL THEN 'not_found' ELSE 'ok' END AS status FROM ({asked}) a LEFT JOIN ({found}) f ON asked = dir"


@catalog.add
def labelled_folders(d: Dialect) -> str:
    like, other = (f"SELECT shot_id, {n} AS label FROM ({photos(d)}) WHERE folder {c}" for n, c in ((1, "< 3"), (0, ">= 7")))
    return f"SELECT label, count(*) AS photos, min(shot_id) AS first_id FROM ({like} UNION ALL {other}) GROUP BY label"


@catalog.add
def unknown_ids_anti(d: Dialect) -> str:
    return "SELECT DISTINCT l_partkey AS id FROM lineitem LEFT ANTI JOIN embeddings ON vec_id = l_partkey" if d.spark else "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey NOT IN (SELECT vec_id FROM embeddings)"


@catalog.add
def selected_ids_semi(d: Dialect) -> str:
    return "SELECT p_partkey AS id, p_name FROM part LEFT SEMI JOIN embeddings ON vec_id = p_partkey" if d.spark else "SELECT p_partkey AS id, p_name FROM part WHERE p_partkey IN (SELECT vec_id FROM embeddings)"


@catalog.add
def override_with_default(d: Dialect) -> str:
    """Per-photo settings over the defaults of the job."""
    return """SELECT v.vec_id AS photo_id, coalesce(o.strength, 0.5) AS strength, coalesce(o.mode, 'auto') AS mode
        FROM embeddings v LEFT JOIN (SELECT p_partkey AS id, p_size / CAST(50 AS DOUBLE) AS strength, lower(p_type) AS mode FROM part WHERE p_partkey % 3 = 0) o ON o.id = v.vec_id"""


@catalog.add
def byte_identity_match(d: Dialect) -> str:
    """Documents whose bytes another document has too, with the first such id."""
    sha = "sha2(text, 256)" if d.spark else "sha256(text)"
    return f"SELECT d.doc_id, m.first_id FROM documents d JOIN (SELECT {sha} AS h, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1) m ON {sha.replace('text', 'd.text')} = m.h WHERE m.n > 1"


# ---- features of one photo ----------------------------------------------------------------------------------------


@catalog.add
def dhash_bits(d: Dialect) -> str:
    """Is each pixel of nine columns brighter than its right neighbour: 64 bits, as text."""
    return f"SELECT shot_id, {hash_bits(d)} AS dhash FROM ({photos(d)})"


@catalog.add
def hamming_pairs(d: Dialect) -> str:
    """Differing bits of each photo and the one taken before it in its folder."""
    diff = " + ".join(f"CASE WHEN substr(dhash, {k}, 1) <> substr(last, {k}, 1) THEN 1 ELSE 0 END" for k in range(1, 65))
    hashed = f"SELECT shot_id, folder, captured_at, {hash_bits(d)} AS dhash FROM ({photos(d)})"
    return f"SELECT shot_id, {diff} AS distance FROM (SELECT *, lag(dhash) OVER (PARTITION BY folder ORDER BY captured_at, shot_id) AS last FROM ({hashed})) WHERE last IS NOT NULL"


def _photo(d: Dialect) -> Picture:
    return Picture(d, photos(d))


@catalog.add
def exposure_score(d: Dialect) -> str:
    return f"SELECT shot_id, round({exposure_of(d)}, 6) AS exposure FROM ({photos(d)})"


@catalog.add
def region_sharpness(d: Dialect) -> str:
    return with_gradients(_photo(d), WHOLE, "whole").select(f"shot_id, round({detail(d, 'whole', WHOLE[0])}, 5) AS sharpness")


@catalog.add
def center_sharpness(d: Dialect) -> str:
    """The central 60 %."""
    return with_gradients(_photo(d), CENTRE, "mid").select(f"shot_id, round({detail(d, 'mid', CENTRE[0])}, 5) AS sharpness")


@catalog.add
def grid3x3_profile(d: Dialect) -> str:
    return f"SELECT shot_id, cell, round({d.at('cells', 'cell')}, 5) AS sharpness FROM ({with_cells(_photo(d)).sql}) {d.series(9, 'cell')}"


@catalog.add
def region_aggregate_top5(d: Dialect) -> str:
    """Median of the five sharpest regions of a photo: the third largest."""
    p = with_cells(_photo(d))
    ordered = "array_sort(cells)" if d.spark else "list_sort(cells)"
    return p.select(f"shot_id, round({d.at(ordered, '6')}, 5) AS sharpness")


@catalog.add
def informative_cells(d: Dialect) -> str:
    """Each photo's median over the five regions of most detail in its burst."""
    return f"SELECT shot_id, round(sharpness, 5) AS sharpness FROM ({features(d)})"


@catalog.add
def absolute_sharpness(d: Dialect) -> str:
    return with_absolute(_photo(d)).select("shot_id, round(quality, 6) AS quality")


@catalog.add
def luma_median(d: Dialect) -> str:
    return f"SELECT shot_id, round({d.percentile('0.2126 * r + 0.7152 * g + 0.0722 * b', 0.5)}, 6) AS luma FROM ({rgb(d)}) GROUP BY shot_id"


@catalog.add
def histogram_256(d: Dialect) -> str:
    """Counts per channel and value, and the largest count of all channels."""
    one = " UNION ALL ".join(f"SELECT '{c}' AS channel, CAST(round({c} * 255) AS INT) AS value FROM ({rgb(d)})" for c in "rgb")
    return f"SELECT channel, value, n, max(n) OVER () AS peak FROM (SELECT channel, value, count(*) AS n FROM ({one}) GROUP BY channel, value)"


# ---- scores within a group ----------------------------------------------------------------------------------------


def smooth(x: str, low: float, high: float) -> str:
    t = f"greatest(0.0, least(1.0, (({x}) - {low}) / CAST({high - low:.10g} AS DOUBLE)))"
    return f"({t} * {t} * (3.0 - 2.0 * {t}))"


def scored(d: Dialect, source: str | None = None, weights: tuple[float, float, float] | None = None) -> str:
    """features with relative sharpness, spreads, weights and score.  Failed shots have no part in any of them.

    source: a table or query with the columns of features; weights: fixed ones of aesthetic, sharpness and exposure.
    """
    source = source or f"({features(d)})"
    w = "OVER (PARTITION BY folder, slot)"
    sound = lambda x: f"CASE WHEN NOT failed THEN {x} END"
    ratio = "greatest(0.0, sharpness / best)"
    norm = f"CASE WHEN failed THEN NULL WHEN best <= 1e-9 THEN 1.0 WHEN {ratio} >= 0.92 THEN 1.0 WHEN {ratio} <= 0.75 THEN 0.0 ELSE {smooth(ratio, 0.75, 0.92)} END"
    one = f"SELECT *, max({sound('sharpness')}) {w} AS best, min({sound('sharpness')}) {w} AS worst, max({sound('exposure')}) {w} - min({sound('exposure')}) {w} AS exposure_spread FROM {source}"
    two = f"SELECT *, {norm} AS norm_sharp, CASE WHEN best <= 1e-9 THEN 0.0 ELSE greatest(0.0, 1.0 - greatest(0.0, worst / best)) END AS sharpness_spread FROM ({one})"
    three = f"SELECT *, 0.25 + 0.15 * {smooth('sharpness_spread', 0.08, 0.25)} AS ws0, 0.05 + 0.20 * {smooth('exposure_spread', 0.03, 0.15)} AS we0 FROM ({two})"
    over = "(ws0 + we0 > 0.55)"
    four = f"SELECT *, CASE WHEN {over} THEN ws0 * (0.55 / (ws0 + we0)) ELSE ws0 END AS w_sharp, CASE WHEN {over} THEN we0 * (0.55 / (ws0 + we0)) ELSE we0 END AS w_exp, CASE WHEN {over} THEN 0.45 ELSE 1.0 - (ws0 + we0) END AS w_aes FROM ({three})"
    if weights:
        total = sum(weights)
        fixed = ", ".join(f"CAST({w / total!r} AS DOUBLE) AS {n}" for w, n in zip(weights, ("w_aes", "w_sharp", "w_exp"), strict=True))
        four = f"SELECT *, {fixed} FROM ({three})"
    return f"SELECT *, CASE WHEN NOT failed THEN aesthetic * w_aes + norm_sharp * w_sharp + exposure * w_exp END AS score FROM ({four})"


@catalog.add
def relative_sharpness(d: Dialect) -> str:
    return f"SELECT shot_id, round(norm_sharp, 6) AS norm_sharp, round(sharpness_spread, 6) AS spread FROM ({scored(d)})"


@catalog.add
def smoothstep(d: Dialect) -> str:
    return f"SELECT event_id, round({smooth('CAST(value AS DOUBLE) / 500', 0.08, 0.25)}, 6) AS s FROM events"


@catalog.add
def adaptive_weights(d: Dialect) -> str:
    signal = lambda x, a, b: f"{smooth(x, a, b)} >= 0.45"
    sharp, expo = signal("sharpness_spread", 0.08, 0.25), signal("exposure_spread", 0.03, 0.15)
    why = f"CASE WHEN {sharp} AND {expo} THEN 'both' WHEN {sharp} THEN 'sharpness' WHEN {expo} THEN 'exposure' ELSE 'aesthetic' END"
    return f"SELECT DISTINCT folder, slot, round(w_aes, 6) AS aesthetic, round(w_sharp, 6) AS sharpness, round(w_exp, 6) AS exposure, {why} AS reason FROM ({scored(d)}) WHERE sharpness_spread IS NOT NULL"


@catalog.add
def custom_weights_normalised(d: Dialect) -> str:
    """Weights over their sum; null where one is negative or all are zero."""
    a, b, c = "CAST(l_discount AS DOUBLE)", "CAST(l_tax AS DOUBLE)", "CAST(l_quantity % 7 - 1 AS DOUBLE)"
    ok = f"{a} >= 0 AND {b} >= 0 AND {c} >= 0 AND {a} + {b} + {c} > 1e-12"
    one = lambda x: f"round(CASE WHEN {ok} THEN {x} / ({a} + {b} + {c}) END, 6)"
    return f"SELECT l_orderkey, l_linenumber, l_partkey, {one(a)} AS aesthetic, {one(b)} AS sharpness, {one(c)} AS exposure FROM lineitem"


def ranked(d: Dialect, keep: int = 2, action: str = "keep", source: str | None = None, weights: tuple[float, float, float] | None = None) -> str:
    """scored with ranks, what is kept, the margin at the boundary and the category of each shot."""
    g = "PARTITION BY folder, slot"
    fit = "NOT failed AND NOT severe_blur AND NOT eye_defect"
    one = f"""SELECT *, CASE WHEN NOT failed THEN row_number() OVER ({g}, failed ORDER BY score DESC, captured_at, shot_id) END AS rnk,
        CASE WHEN {fit} THEN row_number() OVER ({g}, {fit} ORDER BY score DESC, captured_at, shot_id) END AS fit_rnk,
        coalesce(min(CASE WHEN NOT failed THEN CASE WHEN severe_blur THEN 1 ELSE 0 END END) OVER ({g}), 0) = 1 AS all_blurry,
        sum(CASE WHEN {fit} THEN 1 ELSE 0 END) OVER ({g}) AS fits, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER ({g}) AS errors FROM ({scored(d, source, weights)})"""
    n = f"CASE WHEN all_blurry THEN {0 if action == 'reject' else 1} ELSE least({keep}, fits) END"
    two = f"SELECT *, CAST({n} AS INT) AS keep_n, CASE WHEN all_blurry THEN rnk ELSE fit_rnk END AS place FROM ({one})"
    edge = lambda k: f"max(CASE WHEN place = keep_n + {k} THEN score END) OVER ({g})"
    three = f"SELECT *, place <= keep_n AND place IS NOT NULL AS kept, CASE WHEN keep_n > 0 THEN coalesce(greatest(0.0, {edge(0)} - {edge(1)}), 1.0) ELSE 1.0 END AS margin FROM ({two})"
    category = f"CASE WHEN failed OR kept THEN 'keep' WHEN severe_blur OR eye_defect OR (all_blurry AND {'TRUE' if action == 'reject' else 'FALSE'}) THEN 'defect' ELSE 'review' END"
    return f"SELECT *, {category} AS category, errors > 0 OR margin < 0.08 OR (all_blurry AND {'TRUE' if action == 'review' else 'FALSE'}) AS needs_review FROM ({three})"


@catalog.add
def final_score_rank(d: Dialect) -> str:
    return f"SELECT shot_id, round(score, 6) AS score, CAST(rnk AS INT) AS rank FROM ({ranked(d)})"


@catalog.add
def topk_keep(d: Dialect) -> str:
    return f"SELECT shot_id, kept, CAST(keep_n AS INT) AS keep_n FROM ({ranked(d)})"


@catalog.add
def confidence_margin(d: Dialect) -> str:
    return f"SELECT DISTINCT folder, slot, round(margin, 6) AS margin, needs_review FROM ({ranked(d)})"


def _routing(action: str):
    def sql(d: Dialect) -> str:
        reasons = "concat(CASE WHEN eye_defect THEN 'closed_eyes,' ELSE '' END, CASE WHEN severe_blur THEN 'severe_blur,' ELSE '' END, CASE WHEN category = 'review' AND NOT eye_defect AND NOT severe_blur THEN 'lower_score,' ELSE '' END)"
        return f"SELECT shot_id, category, {reasons} AS reasons, needs_review FROM ({ranked(d, 2, action)})"

    sql.__name__ = f"category_routing_{action}"
    return sql


for _action in ("keep", "review", "reject"):
    catalog.add(_routing(_action))


@catalog.add
def argmax_rows(d: Dialect) -> str:
    """The sharpest and the best-looking shot of each group; the first of equals."""
    pick = lambda x: f"max(CASE WHEN n_{x} = 1 THEN shot_id END) AS {x}_shot"
    rank = lambda x: f"row_number() OVER (PARTITION BY folder, slot ORDER BY {x} DESC, captured_at, shot_id) AS n_{x}"
    return f"SELECT folder, slot, {pick('sharpness')}, {pick('aesthetic')} FROM (SELECT *, {rank('sharpness')}, {rank('aesthetic')} FROM ({features(d)}) WHERE NOT failed) GROUP BY folder, slot"


@catalog.add
def group_detail(d: Dialect) -> str:
    return f"""SELECT folder, slot, count(*) AS shot_count, bool_or(all_blurry) AS all_blurry, round(max(margin), 6) AS margin, bool_or(needs_review) AS needs_review,
        sum(CASE WHEN category = 'defect' THEN 1 ELSE 0 END) AS defect_moved, sum(CASE WHEN kept THEN 1 ELSE 0 END) AS kept, round(max(sharpness_spread), 6) AS sharpness_spread,
        round(max(exposure_spread), 6) AS exposure_spread, round(max(score), 6) AS best_score FROM ({ranked(d)}) GROUP BY folder, slot"""


@catalog.add
def run_summary(d: Dialect) -> str:
    count = lambda c, n: f"sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS {n}"
    return f"""SELECT count(*) AS total, {count("size = 1", "skipped_single")}, {count("size > 1 AND category <> 'keep'", "moved")}, {count("size > 1 AND category = 'defect'", "defects")}, {count("failed", "errors")},
        count(DISTINCT CASE WHEN size > 1 THEN concat(CAST(folder AS VARCHAR(9)), '/', CAST(slot AS VARCHAR(20))) END) AS bursts
        FROM (SELECT *, count(*) OVER (PARTITION BY folder, slot) AS size FROM ({ranked(d)}))"""


@catalog.add
def review_queue(d: Dialect) -> str:
    """The 40 groups to look at first: doubtful ones before others, then in order."""
    one = f"SELECT folder, slot, bool_or(needs_review) AS needs_review FROM ({ranked(d)}) GROUP BY folder, slot"
    return f"SELECT folder, slot, needs_review FROM ({one}) ORDER BY CASE WHEN needs_review THEN 0 ELSE 1 END, folder, slot LIMIT 40"


@catalog.add
def single_vs_burst_counts(d: Dialect) -> str:
    return f"SELECT size, count(*) AS bursts FROM (SELECT folder, slot, count(*) AS size FROM ({features(d)}) GROUP BY folder, slot) GROUP BY size"
