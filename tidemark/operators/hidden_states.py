"""Gaussian hidden-state regimes on (return, volatility), fitted by expectation-maximisation.

Observations are packed into shards of bounded length. A round reduces each shard to a K x K
transfer matrix, chains the matrices in two levels to give every shard its incoming and
outgoing weights, takes sufficient statistics per shard and sums them per symbol. A symbol is
settled once its own likelihood gains less than the tolerance, and then takes no part in
further rounds, so its parameters do not depend on the other symbols. Rounds of a series that
is one shard need no other row and run inside one task; the rounds of longer ones are jobs by
the same arithmetic and the same rule. Only parameters (a few dozen numbers per symbol) travel
between jobs, as a written table, so that plans and size estimates do not grow with the rounds.
The recursions step through many shards at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.config import CycleConfig
from tidemark.functions.exprs import back, enough
from tidemark.operators.frame import core_rows, position, shard_of, with_halo
from tidemark.operators.quality import log_return
from tidemark.session import cut, written

LENGTH = 4096
BLOCK = 64  # shards that step together
FAN = 1024
DIM = 2
RIDGE = 1e-3
PARAMS = "start array<double>, trans array<double>, mean array<double>, cov array<double>"


def observations(positioned: DataFrame, length: int = LENGTH) -> DataFrame:
    """(symbol, ts, rn, n, x): log return and its 20-row deviation, numbered where both exist."""
    framed = with_halo(positioned.select("symbol", "ts", "rn", "n", "close"), before=20)
    framed = framed.withColumn("log_return", log_return())
    framed = framed.withColumn("volatility", enough("log_return", 20, F.stddev_samp("log_return").over(back(20))))
    kept = core_rows(framed).filter("log_return IS NOT NULL AND volatility IS NOT NULL")
    kept = kept.select("symbol", "ts", F.array("log_return", "volatility").alias("x"))
    return position(kept)


def pack(obs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per shard with standardised observations in order."""
    stats = obs.groupBy("symbol").agg(
        *[f(F.get("x", F.lit(i))).alias(f"{n}{i}") for i in range(DIM) for f, n in ((F.avg, "_m"), (F.stddev_pop, "_s"))]
    )
    scaled = obs.join(stats, "symbol").select(
        "symbol", "rn", "n",
        F.array(*[F.coalesce(F.try_divide(F.get("x", F.lit(i)) - F.col(f"_m{i}"), F.col(f"_s{i}")), F.lit(0.0)) for i in range(DIM)]).alias("x"),
    )
    return scaled.withColumn("shard", shard_of(F.col("rn"), length)).groupBy("symbol", "shard", "n").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("rn", "x"))), lambda s: s["x"])).alias("x")
    )


# ---- arithmetic on one shard -----------------------------------------------------------


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for i in range(0, len(pdf), BLOCK):
            yield pdf.iloc[i:i + BLOCK].reset_index(drop=True)


def _array(column: pd.Series, *shape: int) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in column]).reshape(len(column), *shape)


def _unpack(pdf: pd.DataFrame, k: int):
    return _array(pdf["start"], k), _array(pdf["trans"], k, k), _array(pdf["mean"], k, DIM), _array(pdf["cov"], k, DIM, DIM)


def _padded(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Observations of the shards, filled up to the longest, and which of them are real."""
    parts = [np.asarray(v, float).reshape(-1, DIM) for v in column]
    x = np.zeros((len(parts), max(map(len, parts)), DIM))
    valid = np.zeros(x.shape[:2], bool)
    for i, part in enumerate(parts):
        x[i, :len(part)] = part
        valid[i, :len(part)] = True
    return x, valid


def _log_density(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    away = x[:, :, None, :] - mean[:, None]
    quad = ((away[..., None, :] @ np.linalg.inv(cov)[:, None])[..., 0, :] * away).sum(-1)
    return -0.5 * (quad + np.linalg.slogdet(cov)[1][:, None] + DIM * np.log(2 * np.pi))


def _densities(x: np.ndarray, valid: np.ndarray, params) -> tuple[np.ndarray, np.ndarray]:
    """Densities divided by the largest of their row, and the logarithm of that; 1 and 0 where nothing is observed."""
    logs = _log_density(x, params[2], params[3])
    shift = logs.max(2)
    return np.where(valid[:, :, None], np.exp(logs - shift[:, :, None]), 1.0), np.where(valid, shift, 0.0)


def _transfer(dens: np.ndarray, valid: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Product of each shard's one-step matrices, scaled; the first row of a series has no step."""
    one = np.eye(trans.shape[1])
    total = np.broadcast_to(one, trans.shape)
    for t in range(dens.shape[1]):
        step = trans * dens[:, t, None, :]
        if t == 0:
            step = np.where(first[:, None, None], one * dens[:, 0, None, :], step)
        ahead = total @ step
        total = np.where(valid[:, t, None, None], ahead / ahead.max((1, 2), keepdims=True), total)
    return total


def _statistics(x: np.ndarray, valid: np.ndarray, params, alpha_in: np.ndarray, beta_out: np.ndarray, first: np.ndarray) -> dict:
    """Expected counts and moments of each shard, and its log-likelihood."""
    start, trans = params[:2]
    dens, shift = _densities(x, valid, params)
    shards, size, k = dens.shape
    alpha, beta, scale = np.empty(dens.shape), np.empty(dens.shape), np.ones((shards, size))
    current = alpha_in
    for t in range(size):
        ahead = (current[:, None, :] @ trans)[:, 0]
        if t == 0:
            ahead = np.where(first[:, None], start, ahead)
        current = ahead * dens[:, t]
        scale[:, t] = current.sum(1)
        current = current / scale[:, t, None]
        alpha[:, t] = current
    current = beta_out / beta_out.sum(1, keepdims=True)
    for t in range(size - 1, -1, -1):
        beta[:, t] = current
        behind = (trans @ (dens[:, t] * current)[:, :, None])[:, :, 0]
        current = np.where(valid[:, t, None], behind / behind.sum(1, keepdims=True), current)
    gamma = alpha * beta
    gamma = np.where(valid[:, :, None], gamma / gamma.sum(2, keepdims=True), 0.0)
    before = np.concatenate([alpha_in[:, None], alpha[:, :-1]], 1)
    pair = before[:, :, :, None] * trans[:, None] * (dens * beta)[:, :, None, :]
    steps = valid.copy()
    steps[first, 0] = False
    pair = (pair * np.where(steps, 1 / pair.sum((2, 3)), 0.0)[:, :, None, None]).sum(1)
    return {
        "g0": np.where(first[:, None], gamma[:, 0], 0.0), "g": gamma.sum(1), "pair": pair, "gx": gamma.transpose(0, 2, 1) @ x,
        "gxx": np.einsum("stk,stp->skp", gamma, (x[:, :, :, None] * x[:, :, None, :]).reshape(shards, size, -1), optimize=True).reshape(shards, k, DIM, DIM),
        "loglik": np.where(valid, np.log(scale), 0.0).sum(1) + shift.sum(1),
    }


def _maximise(s: dict) -> tuple:
    start = s["g0"] / s["g0"].sum(1, keepdims=True)
    trans = (s["pair"] + 1e-6) / (s["pair"] + 1e-6).sum(2, keepdims=True)
    weight = np.maximum(s["g"], 1e-9)
    mean = s["gx"] / weight[:, :, None]
    cov = s["gxx"] / weight[:, :, None, None] - mean[..., :, None] * mean[..., None, :] + RIDGE * np.eye(DIM)
    return start, trans, mean, cov


def _initial(k: int):
    """States spread over the return axis of the standardised plane: no random numbers."""
    mean = np.zeros((k, DIM))
    mean[:, 0] = np.linspace(-1, 1, k)
    stay = 0.9 if k > 1 else 1.0
    trans = np.full((k, k), (1 - stay) / max(1, k - 1)) + (stay - (1 - stay) / max(1, k - 1)) * np.eye(k)
    return np.full(k, 1 / k), trans, mean, np.stack([np.eye(DIM)] * k)


def _fit_whole(x: np.ndarray, valid: np.ndarray, k: int, rounds: int, tolerance: float) -> tuple:
    """All rounds of series that are one shard each; a settled one stays as it is."""
    n = len(x)
    params = tuple(np.repeat(p[None], n, 0) for p in _initial(k))
    last, open_ = np.full(n, -np.inf), np.arange(n)
    for _ in range(rounds):
        own = tuple(p[open_] for p in params)
        s = _statistics(x[open_], valid[open_], own, own[0], np.ones((len(open_), k)), np.ones(len(open_), bool))
        for p, new in zip(params, _maximise(s)):
            p[open_] = new
        going = ~(s["loglik"] - last[open_] < tolerance)
        last[open_] = s["loglik"]
        open_ = open_[going]
        if not len(open_):
            break
    return params


def _rows(params) -> dict[str, list]:
    return {name: [v.ravel().tolist() for v in values] for name, values in zip(("start", "trans", "mean", "cov"), params)}


# ---- chaining shards -------------------------------------------------------------------


def _chain(mats: DataFrame, k: int) -> DataFrame:
    """Weights entering and leaving each shard, from (symbol, shard, m, start), in two levels."""
    schema = "symbol string, grp long, shard long, before array<double>, after array<double>, total array<double>"

    def scan(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        ms = [np.asarray(m, float).reshape(k, k) for m in pdf["m"]]
        before, run = [], np.eye(k)
        for m in ms:
            before.append(run.ravel().tolist())
            run = run @ m
            run = run / run.max()
        after, tail = [], np.eye(k)
        for m in reversed(ms):
            after.append(tail.ravel().tolist())
            tail = m @ tail
            tail = tail / tail.max()
        return pd.DataFrame(
            {"symbol": key[0], "grp": key[1], "shard": pdf["shard"].values, "before": before, "after": after[::-1], "total": [run.ravel().tolist()] * len(ms)}
        )

    low = mats.withColumn("grp", F.floor(F.col("shard") / FAN)).groupBy("symbol", "grp").applyInPandas(scan, schema)
    heads = low.groupBy("symbol", "grp").agg(F.first("total").alias("m"))
    high = heads.select("symbol", F.lit(0).cast("long").alias("_z"), F.col("grp").alias("shard"), "m").groupBy("symbol", "_z").applyInPandas(scan, schema)
    high = high.select("symbol", F.col("shard").alias("grp"), F.col("before").alias("up_before"), F.col("after").alias("up_after"))
    return low.select("symbol", "grp", "shard", "before", "after").join(high, ["symbol", "grp"]).drop("grp")


def _long_fit(packed: DataFrame, config: CycleConfig, tolerance: float) -> DataFrame:
    """Rounds as jobs: ``packed`` has several shards per symbol."""
    k = config.n_states
    begin = _rows(p[None] for p in _initial(k))
    literal = [F.array(*[F.lit(v) for v in begin[c][0]]).alias(c) for c in ("start", "trans", "mean", "cov")]
    params = written(packed.select("symbol").distinct().select(
        "symbol", *literal, F.lit(float("-inf")).alias("loglik"), F.lit(False).alias("settled")))

    def transfer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _blocks(batches):
            p = _unpack(pdf, k)
            x, valid = _padded(pdf["x"])
            mats = _transfer(_densities(x, valid, p)[0], valid, p[1], (pdf["shard"] == 0).to_numpy())
            yield pd.DataFrame({"symbol": pdf["symbol"], "shard": pdf["shard"], "m": [m.ravel().tolist() for m in mats]})

    def statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _blocks(batches):
            p = _unpack(pdf, k)
            mats = {c: _array(pdf[c], k, k) for c in ("before", "after", "up_before", "up_after")}
            alpha = (p[0][:, None, :] @ mats["up_before"] @ mats["before"])[:, 0]
            beta = (mats["after"] @ mats["up_after"]).sum(2)
            x, valid = _padded(pdf["x"])
            s = _statistics(x, valid, p, alpha / alpha.sum(1, keepdims=True), beta, (pdf["shard"] == 0).to_numpy())
            flat = np.concatenate([s[c].reshape(len(pdf), -1) for c in ("g0", "g", "pair", "gx", "gxx", "loglik")], 1)
            yield pd.DataFrame({"symbol": pdf["symbol"], "s": flat.tolist()})

    width = 2 * k + k * k + k * DIM + k * DIM * DIM + 1

    def maximise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _blocks(batches):
            g0, g, pair, gx, gxx, loglik = np.split(_array(pdf["s"], width), np.cumsum([k, k, k * k, k * DIM, k * DIM * DIM]), axis=1)
            n = len(pdf)
            new = _maximise({"g0": g0, "g": g, "pair": pair.reshape(n, k, k), "gx": gx.reshape(n, k, DIM), "gxx": gxx.reshape(n, k, DIM, DIM)})
            yield pd.DataFrame({
                "symbol": pdf["symbol"], **_rows(new), "loglik": loglik[:, 0], "settled": loglik[:, 0] - pdf["last"].to_numpy() < tolerance})

    for _ in range(config.max_iterations):
        going = params.filter("not settled")
        fed = packed.join(going.select("symbol", "start", "trans", "mean", "cov"), "symbol")
        edges = _chain(fed.mapInPandas(transfer, "symbol string, shard long, m array<double>"), k)
        sums = fed.join(edges, ["symbol", "shard"]).mapInPandas(statistics, "symbol string, s array<double>")
        total = sums.groupBy("symbol").agg(F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(width)]).alias("s"))
        total = total.join(going.select("symbol", F.col("loglik").alias("last")), "symbol")
        moved = total.mapInPandas(maximise, f"symbol string, {PARAMS}, loglik double, settled boolean")
        params = written(moved.unionByName(params.filter("settled")))
        if params.filter("not settled").isEmpty():
            break
    return params.select("symbol", "start", "trans", "mean", "cov")


def fit(obs: DataFrame, config: CycleConfig = CycleConfig(), tolerance: float = 1e-2, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Parameters per symbol (standardised plane) and the packed observations they belong to. Runs jobs."""
    k = config.n_states
    packed = written(pack(obs.filter(F.col("n") >= 10 * k), length))
    rounds = config.max_iterations

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _blocks(batches):
            yield pd.DataFrame({"symbol": pdf["symbol"], **_rows(_fit_whole(*_padded(pdf["x"]), k, rounds, tolerance))})

    short = packed.filter(F.col("n") <= length).select("symbol", "x").mapInPandas(whole, f"symbol string, {PARAMS}")
    long = packed.filter(F.col("n") > length)
    if long.isEmpty():
        return written(short), packed
    return written(short.unionByName(_long_fit(long, config, tolerance))), packed


def decode(packed: DataFrame, params: DataFrame, config: CycleConfig = CycleConfig(), length: int = LENGTH) -> DataFrame:
    """(symbol, rn, state): the most likely path.

    The best path through a shard is a max-plus matrix from its entry to its exit state; the
    matrices are chained like the sums, and each shard then walks back between fixed ends.
    """
    k = config.n_states

    def scores(pdf: pd.DataFrame):
        start, trans, mean, cov = _unpack(pdf, k)
        x, valid = _padded(pdf["x"])
        with np.errstate(divide="ignore"):
            return _log_density(x, mean, cov), valid, np.log(trans), np.log(start), (pdf["shard"] == 0).to_numpy()

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _blocks(batches):
            logs, valid, trans, start, first = scores(pdf)
            best = np.where(first[:, None, None], start[:, None, :], trans) + logs[:, 0, None, :]
            for t in range(1, logs.shape[1]):
                ahead = (best[:, :, :, None] + trans[:, None]).max(2) + logs[:, t, None, :]
                best = np.where(valid[:, t, None, None], ahead, best)
            yield pd.DataFrame({"symbol": pdf["symbol"], "shard": pdf["shard"], "m": [m.ravel().tolist() for m in best]})

    def join_ends(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Exit state of every shard of a group, given the group's entry and exit scores."""
        pdf = pdf.sort_values("shard")
        ms = [np.asarray(m, float).reshape(k, k) for m in pdf["m"]]
        forward = [np.asarray(pdf["enter"].iloc[0], float)]
        for m in ms:
            v = (forward[-1][:, None] + m).max(0)
            forward.append(v - v.max())
        backward = [np.asarray(pdf["leave"].iloc[0], float)]
        for m in reversed(ms):
            v = (m + backward[-1][None, :]).max(1)
            backward.append(v - v.max())
        backward = backward[::-1]
        state = int(np.argmax(forward[-1] + backward[-1]))
        exits, into = [0] * len(ms), [0] * len(ms)
        for i in range(len(ms) - 1, -1, -1):
            exits[i] = state
            state = int(np.argmax(forward[i] + ms[i][:, state]))
            into[i] = state
        return pd.DataFrame({"symbol": key[0], "shard": pdf["shard"].values, "into": into, "exit": exits})

    def heads(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        total = np.asarray(pdf["m"].iloc[0], float).reshape(k, k)
        for m in list(pdf["m"])[1:]:
            total = (total[:, :, None] + np.asarray(m, float).reshape(k, k)[None]).max(1)
        return pd.DataFrame({"symbol": [key[0]], "grp": [key[1]], "m": [total.ravel().tolist()]})

    def outer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("grp")
        ms = [np.asarray(m, float).reshape(k, k) for m in pdf["m"]]
        enter, leave = [np.zeros(k)], [np.zeros(k)]
        for m in ms:
            v = (enter[-1][:, None] + m).max(0)
            enter.append(v - v.max())
        for m in reversed(ms):
            v = (m + leave[-1][None, :]).max(1)
            leave.append(v - v.max())
        leave = leave[::-1]
        return pd.DataFrame(
            {"symbol": key[0], "grp": pdf["grp"].values, "enter": [e.tolist() for e in enter[:-1]], "leave": [e.tolist() for e in leave[1:]]}
        )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _blocks(batches):
            logs, valid, trans, start, first = scores(pdf)
            each = np.arange(len(pdf))
            best = np.where(first[:, None], start, trans[each, pdf["into"].to_numpy()]) + logs[:, 0]
            origin = np.zeros(logs.shape, dtype=np.int32)
            for t in range(1, logs.shape[1]):
                options = best[:, :, None] + trans
                origin[:, t] = options.argmax(1)
                best = np.where(valid[:, t, None], options.max(1) + logs[:, t], best)
            state, path = pdf["exit"].to_numpy().copy(), np.empty(valid.shape, dtype=np.int32)
            for t in range(logs.shape[1] - 1, -1, -1):
                path[:, t] = state
                state = np.where(valid[:, t], origin[each, t, state], state)
            at = np.arange(1, logs.shape[1] + 1)[None, :] + pdf["shard"].to_numpy()[:, None] * length
            yield pd.DataFrame({"symbol": np.repeat(pdf["symbol"].to_numpy(), valid.sum(1)), "rn": at[valid], "state": path[valid]})

    fed = packed.join(params, "symbol")
    mats = written(fed.mapInPandas(ends, "symbol string, shard long, m array<double>").withColumn("grp", F.floor(F.col("shard") / FAN)))
    tops = mats.groupBy("symbol", "grp").applyInPandas(heads, "symbol string, grp long, m array<double>")
    sides = tops.groupBy("symbol").applyInPandas(outer, "symbol string, grp long, enter array<double>, leave array<double>")
    fixed = mats.join(sides, ["symbol", "grp"]).groupBy("symbol", "grp").applyInPandas(join_ends, "symbol string, shard long, into int, exit int")
    return fed.join(fixed, ["symbol", "shard"]).mapInPandas(walk, "symbol string, rn long, state int")


NAMES = {2: ("bear", "bull"), 3: ("bear", "sideways", "bull")}


def name_states(states: DataFrame, obs: DataFrame, n_states: int = 3) -> DataFrame:
    """Rank each symbol's states by mean return and name them from low to high."""
    from pyspark.sql import Window

    joined = obs.join(states, ["symbol", "rn"])
    means = joined.groupBy("symbol", "state").agg(F.avg(F.get("x", F.lit(0))).alias("mean_return"), F.avg(F.get("x", F.lit(1))).alias("mean_volatility"))
    w = Window.partitionBy("symbol").orderBy("mean_return", "state")
    rank = F.row_number().over(w) - 1
    fixed = NAMES.get(n_states)
    name = F.get(F.array(*[F.lit(x) for x in fixed]), rank) if fixed else F.concat(F.lit("regime_"), rank)
    named = means.withColumn("regime", name)
    return joined.join(named, ["symbol", "state"])


def parameters(params: DataFrame, obs: DataFrame, n_states: int = 3) -> DataFrame:
    """State means in the original units and the transition matrix, one row per state."""
    stats = obs.groupBy("symbol").agg(
        *[f(F.get("x", F.lit(i))).alias(f"{n}{i}") for i in range(DIM) for f, n in ((F.avg, "_m"), (F.stddev_pop, "_s"))]
    )
    rows = params.join(stats, "symbol").select("*", F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))).alias("state"))

    def original(i: int):
        return F.get("mean", F.col("state") * DIM + i) * F.col(f"_s{i}") + F.col(f"_m{i}")

    return rows.select(
        "symbol", "state", original(0).alias("mean_return"), original(1).alias("mean_volatility"),
        F.slice("trans", F.col("state") * n_states + 1, n_states).alias("transition"),
    )


def regimes(positioned: DataFrame, config: CycleConfig = CycleConfig(), length: int = LENGTH) -> dict[str, DataFrame]:
    """``states`` (symbol, ts, rn, n, state, regime, ...) and ``parameters``."""
    obs = cut(observations(positioned, length))
    params, packed = fit(obs, config, length=length)
    states = decode(packed, params, config, length)
    return {"states": name_states(states, obs, config.n_states), "parameters": parameters(params, obs, config.n_states)}
