"""Jobs, sessions, caches, progress, move plans and model scores."""

from __future__ import annotations

from .dialect import Catalog, Dialect

catalog = Catalog()


@catalog.add
def job_progress(d: Dialect) -> str:
    """Counters of a job; an item is done when it succeeded or failed."""
    n = lambda c: f"sum(CASE WHEN {c} THEN 1 ELSE 0 END)"
    ok, bad = "event_type IN ('purchase', 'signup')", "event_type = 'error'"
    return f"SELECT user_id AS job_id, count(*) AS total, {n(f'{ok} OR {bad}')} AS processed, {n(ok)} AS success, {n(bad)} AS failed, round({n(f'{ok} OR {bad}')} / CAST(greatest(1, count(*)) AS DOUBLE), 4) AS progress FROM events GROUP BY user_id"


@catalog.add
def status_summary(d: Dialect) -> str:
    n = lambda s: f"sum(CASE WHEN event_type = '{s}' THEN 1 ELSE 0 END) AS n_{s}"
    return f"SELECT {', '.join(map(n, ('view', 'click', 'error', 'purchase', 'signup')))}, count(*) AS total FROM events"


@catalog.add
def latest_generation(d: Dialect) -> str:
    """Requests that no newer one of their session and client replaced."""
    return "SELECT user_id AS session_id, event_type AS client_id, event_id AS generation FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id, event_type) AS newest FROM events) WHERE event_id = newest"


@catalog.add
def cache_budget_window(d: Dialect) -> str:
    """Newest entries of a session that fit in 32 places and 2000 units together."""
    w = "OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    size = "CAST(floor(value) AS BIGINT)"
    return f"SELECT user_id, event_id FROM (SELECT user_id, event_id, sum({size}) {w} AS used, count(*) {w} AS n FROM events) WHERE used <= 2000 AND n <= 32"


@catalog.add
def session_eviction(d: Dialect) -> str:
    """The eight sessions used last stay."""
    return "SELECT session_id, last_event FROM (SELECT user_id AS session_id, max(event_id) AS last_event FROM events GROUP BY user_id) ORDER BY last_event DESC LIMIT 8"


@catalog.add
def idle_expiry(d: Dialect) -> str:
    """Keys that were idle for more than 300 s before the end."""
    t = d.micros("ts")
    return f"SELECT user_id, last_us FROM (SELECT user_id, max({t}) AS last_us FROM events GROUP BY user_id) CROSS JOIN (SELECT max({t}) AS end_us FROM events) WHERE end_us - last_us > 300 * CAST(1000000 AS BIGINT)"


@catalog.add
def progress_every_n(d: Dialect) -> str:
    one = "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events"
    return f"SELECT user_id, n, total FROM ({one}) WHERE n % 50 = 0 OR n = total"


@catalog.add
def suppress_duplicate_progress(d: Dialect) -> str:
    one = "SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events"
    return f"SELECT user_id, event_id, event_type FROM ({one}) WHERE before IS NULL OR before <> event_type"


@catalog.add
def gap_sessions(d: Dialect) -> str:
    """Sessions by a gap of six hours alone."""
    t = d.micros("ts")
    one = f"SELECT user_id, event_id, ts, CASE WHEN {t} - lag({t}) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 21600 * CAST(1000000 AS BIGINT) THEN 0 ELSE 1 END AS starts FROM events"
    return f"SELECT user_id, event_id, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM ({one})"


@catalog.add
def move_plan(d: Dialect) -> str:
    """Where each file goes: the n-th of equal names gets _dupN; files of one shot keep their order."""
    name = "concat(p_brand, '_', CAST(p_size AS VARCHAR(9)))"
    n = "row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) - 1"
    return f"SELECT p_partkey, concat('review/', name, CASE WHEN n = 0 THEN '' ELSE concat('_dup', CAST(n AS VARCHAR(9))) END, '.jpg') AS dst FROM (SELECT p_partkey, {name} AS name, {n} AS n FROM part)"


@catalog.add
def decision_toggle(d: Dialect) -> str:
    """The last decision for each photo; one repeated in a row changes nothing."""
    kept = "event_type IN ('purchase', 'signup', 'view')"
    one = f"SELECT user_id, event_id, {kept} AS kept, lag({kept}) OVER (PARTITION BY user_id ORDER BY event_id) AS before, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events"
    return f"SELECT user_id, max(CASE WHEN n = 1 THEN CASE WHEN kept THEN 1 ELSE 0 END END) AS kept, sum(CASE WHEN before IS NULL OR before <> kept THEN 1 ELSE 0 END) AS moves FROM ({one}) GROUP BY user_id"


def norm(d: Dialect) -> str:
    return f"sqrt({d.total(d.each('embedding', 'v', 'CAST(v AS DOUBLE) * CAST(v AS DOUBLE)'))})"


@catalog.add
def l2_normalise(d: Dialect) -> str:
    unit = f"round(CAST({d.at('embedding', 'i')} AS DOUBLE) / greatest(norm, 1e-12), 6) AS unit"
    return f"SELECT vec_id, i, round(norm, 6) AS norm, {unit} FROM (SELECT vec_id, embedding, {norm(d)} AS norm FROM embeddings) {d.series(64, 'i')}"


def dot(d: Dialect, weights: list[float], array: str = "embedding") -> str:
    return "(" + " + ".join(f"CAST({d.at(array, str(i))} AS DOUBLE) * ({w:.6f})" for i, w in enumerate(weights)) + ")"


@catalog.add
def linear_head_score(d: Dialect) -> str:
    """A linear head on the unit vector, scaled to 0..1."""
    w = [((i * 37) % 19 - 9) / 10 for i in range(64)]
    return f"SELECT vec_id, round(greatest(0.0, least(1.0, ({dot(d, w)} / greatest({norm(d)}, 1e-12) + 5.0) / 10.0)), 6) AS score FROM embeddings"


@catalog.add
def mlp_forward(d: Dialect) -> str:
    """A two-layer ReLU head with fixed weights: probability of the second class."""
    h = [f"greatest(0.0, {dot(d, [((i * (k + 3) * 13) % 23 - 11) / 12 for i in range(64)])} + {0.1 * k:.6f}) AS h{k}" for k in range(6)]
    z = " + ".join(f"h{k} * ({(k * 7 % 5 - 2) / 3:.6f})" for k in range(6))
    return f"SELECT vec_id, round(1.0 / (1.0 + exp(-({z}))), 6) AS p FROM (SELECT vec_id, {', '.join(h)} FROM embeddings)"


@catalog.add
def like_dislike_counts(d: Dialect) -> str:
    return "SELECT quality, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS dislikes, sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) AS likes, count(*) AS n FROM labels GROUP BY quality"


@catalog.add
def model_readiness(d: Dialect) -> str:
    """Which model files are there and large enough."""
    return "SELECT s_suppkey, s_acctbal > 0 AS present, s_acctbal > 1000 AS ready FROM supplier"


@catalog.add
def presets_dimension_join(d: Dialect) -> str:
    """Orders with the settings of their preset: a lookup in a small dimension."""
    return "SELECT o.o_orderkey, n.n_name AS preset, r.r_name AS family FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey"
