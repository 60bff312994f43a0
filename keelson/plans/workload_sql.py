"""Workloads in SQL: the same draws, a step for each turn of a recursive query.

SplitMix64 is exact in 128-bit integers; draws are numbered, so a run's outputs are a list and a step only
moves a position in it.
"""

from __future__ import annotations

from keelson.config import WorkloadSpec
from keelson.functions.prng import MIX, PHI, derive_seed

_WORD = 1 << 64


def _outputs(runs: int, base: int, count: int) -> str:
    """out: run_id, seed and arr, the first `count` outputs of each run."""
    seeds = ", ".join(f"({k}, '{derive_seed(base, k)}'::UHUGEINT)" for k in range(runs))
    steps = [f"(seed + n::UHUGEINT * {PHI}::UHUGEINT) % {_WORD}::UHUGEINT"]
    for shift, factor in MIX[:2]:
        steps.append(f"(xor(z, z // {1 << shift}::UHUGEINT) * {factor}::UHUGEINT) % {_WORD}::UHUGEINT")
    steps.append(f"xor(z, z // {1 << MIX[2]}::UHUGEINT)")
    body = f"SELECT run_id, seed, n, {steps[0]} AS z FROM (VALUES {seeds}) s(run_id, seed), range(1, {count + 1}) t(n)"
    for step in steps[1:]:
        body = f"SELECT run_id, seed, n, {step} AS z FROM ({body})"
    return f"out AS (SELECT run_id, seed, list(z ORDER BY n) AS arr FROM ({body}) GROUP BY run_id, seed)"


def _below(at: str, bound: str) -> str:
    """A number below bound of the two outputs from position `at` (from 0)."""
    return f"CAST((arr[{at} + 1] * {_WORD}::UHUGEINT + arr[{at} + 2]) % ({bound})::UHUGEINT AS BIGINT)"


def _unit(at: str) -> str:
    return f"CAST(arr[{at} + 1] AS DOUBLE) / 18446744073709551616.0"


def _batch(draw: str, per: int, lead: str, size: int, most: int) -> tuple[str, str]:
    """The keys of a batch and the outputs it takes: `size` distinct ones of the draws, as many as that needs."""
    drawn = f"list_transform(range({most}), lambda j: {draw})"
    firsts = "list_filter(range(len(drawn)), lambda j: list_position(drawn, drawn[j + 1]) = j + 1)"
    return drawn, f"SELECT *, list_sort(list_transform(firsts[1:{size}], lambda j: drawn[j + 1])) AS batch, {lead} + {per} * (firsts[{size}] + 1) AS taken FROM (SELECT *, {firsts} AS firsts FROM ({{}}))"


def steps(pattern: str, spec: WorkloadSpec, runs: int, base: int) -> str:
    """WITH RECURSIVE parts that end in stp: run_id, seed, step, kind, keys (list), key, version and payload (hexadecimal)."""
    space, size = spec.key_space, spec.query_batch_size
    clusters, span = spec.cluster_count, -(-spec.key_space // spec.cluster_count)
    half = space // 2
    count = spec.mixed_steps if pattern == "MixedReadWrite" else spec.num_query_batches
    clustered = f"least(least({_below('pos + head', str(clusters))} * {span}, {space - 1}) + {_below('pos + head + 2 + 2 * j', str(span))}, {space - 1})"
    uniform = _below("pos + head + 2 * j", str(space))
    shares = ""
    draw, per, lead, most = uniform, 2, "head", 64
    head, kind, write = "0", "'query'", ("NULL::BIGINT", "NULL::BIGINT", "NULL::VARCHAR", "0")
    if pattern == "Clustered":
        draw, lead = clustered, "head + 2"
    elif pattern == "SkewedZipfian":
        shares = f"cdf AS (SELECT list(c ORDER BY r) AS cdf FROM (SELECT r, sum(w) OVER (ORDER BY r) / (SELECT sum(1 / pow(q, {spec.zipf_s})) FROM range(1, {space + 1}) x(q)) AS c FROM (SELECT r, 1 / pow(r, {spec.zipf_s}) AS w FROM range(1, {space + 1}) y(r)))), "
        draw, per, most = f"least(len(list_filter(cdf, lambda c: c < {_unit('pos + j')})), {space - 1})", 1, 200
    elif pattern == "AdversarialAlternating":
        draw = f"least(CASE WHEN (step + 1) % 2 = 0 THEN {_below('pos + 2 * j', str(half))} ELSE {half} + {_below('pos + 2 * j', str(space - half))} END, {space - 1})"
    elif pattern == "MixedReadWrite":
        reads, evenly = f"({_unit('pos')} < {spec.read_fraction})", f"({_unit('pos + 1')} < 0.5)"
        draw, lead, head = f"CASE WHEN {evenly} THEN {uniform} ELSE {clustered} END", f"CASE WHEN {evenly} THEN head ELSE head + 2 END", "2"
        kind = f"CASE WHEN {reads} THEN 'query' ELSE 'write' END"
        octets = f"list_transform(range({spec.write_payload_len}), lambda j: printf('%02X', CAST(arr[pos + 4 + j] % 256::UHUGEINT AS INT)))"
        write = tuple(f"CASE WHEN NOT {reads} THEN {x} END" for x in (_below("pos + 1", str(space)), "1::BIGINT", f"array_to_string({octets}, '')")) + (f"CASE WHEN {reads} THEN 0 ELSE {3 + spec.write_payload_len} END",)
    drawn, finish = _batch(draw, per, lead, size, most)
    turn = f"SELECT r.run_id, r.step, r.pos, {head} AS head, arr{', cdf' if shares else ''} FROM rec r JOIN out ON out.run_id = r.run_id{' CROSS JOIN cdf' if shares else ''} WHERE r.step + 1 < {count}"
    made = finish.format(f"SELECT *, {drawn} AS drawn FROM ({turn})")
    read = "kind = 'query'"
    return (
        f"{_outputs(runs, base, count * (90 if pattern != 'SkewedZipfian' else 60) + 400)}, {shares}"
        f"rec AS (SELECT run_id, -1 AS step, 0::BIGINT AS pos, ''::VARCHAR AS kind, []::BIGINT[] AS keys, NULL::BIGINT AS key, NULL::BIGINT AS version, NULL::VARCHAR AS payload FROM out "
        f"UNION ALL SELECT run_id, step + 1, CAST(pos + CASE WHEN {read} THEN taken ELSE used END AS BIGINT), kind, CASE WHEN {read} THEN batch END, key, version, payload "
        f"FROM (SELECT *, {kind} AS kind, {write[0]} AS key, {write[1]} AS version, {write[2]} AS payload, {write[3]} AS used FROM ({made}))), "
        f"stp AS (SELECT rec.run_id, seed, step, kind, keys, key, version, payload FROM rec JOIN out ON out.run_id = rec.run_id WHERE step >= 0)"
    )


def query(pattern: str, spec: WorkloadSpec, runs: int, base: int) -> str:
    return f"WITH RECURSIVE {steps(pattern, spec, runs, base)} SELECT '{pattern}' AS scenario, CAST(run_id AS INT) AS run_id, step, kind, array_to_string(keys, ',') AS keys, key, version, payload FROM stp"


def digest(pattern: str, spec: WorkloadSpec, runs: int, base: int) -> str:
    """workload.digest() of one pattern."""
    line = "concat_ws('|', step, kind, array_to_string(keys, ','), key, version, payload)"
    return f"WITH RECURSIVE {steps(pattern, spec, runs, base)} SELECT '{pattern}' AS scenario, CAST(run_id AS INT) AS run_id, sha256(concat_ws(',', CAST(seed AS VARCHAR), string_agg(sha256({line}), ',' ORDER BY step))) AS digest FROM stp GROUP BY run_id, seed"
