"""Graph operators over a corpus of flows: every flow is small, there are many, and all is keyed by flow_id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .outcomes import loop_first

MAX_NODES, MAX_BYTES, INLINE_CAP = 16, 16_384, 20


def forward(edges: DataFrame, back: DataFrame) -> DataFrame:
    return edges.join(back.select("flow_id", "pos"), ["flow_id", "pos"], "left_anti")


def roots(nodes: DataFrame, forward_edges: DataFrame) -> DataFrame:
    """GRF-1: nodes without an incoming forward edge."""
    into = forward_edges.select("flow_id", F.col("dst").alias("node_id"))
    return nodes.join(into, ["flow_id", "node_id"], "left_anti").select("flow_id", "node_id")


def walk(nodes: list[str], edges: list[tuple[int, str, str]]) -> tuple[list[int], list[str]]:
    """(positions of back edges under depth-first search in declaration order, topological order over the others)."""
    out: dict[str, list[tuple[int, str]]] = {n: [] for n in nodes}
    for pos, a, b in edges:
        if a in out and b in out:
            out[a].append((pos, b))
    color, back = dict.fromkeys(nodes, 0), []
    for start in nodes:
        if color[start]:
            continue
        color[start], stack = 1, [(start, iter(out[start]))]
        while stack:
            node, rest = stack[-1]
            for pos, to in rest:
                if color[to] == 1:
                    back.append(pos)
                elif not color[to]:
                    color[to] = 1
                    stack.append((to, iter(out[to])))
                    break
            else:
                color[node] = 2
                stack.pop()
    skip, degree = set(back), dict.fromkeys(nodes, 0)
    ahead = {n: [to for pos, to in e if pos not in skip] for n, e in out.items()}
    for e in ahead.values():
        for to in e:
            degree[to] += 1
    queue = [n for n in nodes if not degree[n]]
    for n in queue:
        for to in ahead[n]:
            degree[to] -= 1
            if not degree[to]:
                queue.append(to)
    return back, queue + [n for n in nodes if n not in set(queue)]


def _walked(nodes: DataFrame, edges: DataFrame, run, schema: str) -> DataFrame:
    """run(flow_id, nodes, edges) for each flow: its nodes and edges as two ordered arrays of one row; schema follows flow_id."""
    schema = f"flow_id {nodes.schema['flow_id'].dataType.simpleString()}, {schema}"
    n = nodes.groupBy("flow_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]).alias("nodes"))
    e = edges.groupBy("flow_id").agg(F.array_sort(F.collect_list(F.struct("pos", "src", "dst"))).alias("edges"))

    def batches(frames):
        for pdf in frames:
            rows = []
            for flow, names, links in zip(pdf["flow_id"], pdf["nodes"], pdf["edges"], strict=True):
                rows += run(flow, list(names), [] if links is None else [(x["pos"], x["src"], x["dst"]) for x in links])
            yield type(pdf)(rows, columns=[p.split()[0] for p in schema.split(", ")])

    return n.join(e, "flow_id", "left").mapInPandas(batches, schema)


def back_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF-2: edges that close a cycle under depth-first search in declaration order."""
    return _walked(nodes, edges, lambda f, n, e: [(f, p) for p in walk(n, e)[0]], "pos long")


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF-3: first-in first-out order over forward edges; leftovers at the end, edges to unknown nodes ignored."""
    return _walked(nodes, edges, lambda f, n, e: [(f, x, i) for i, x in enumerate(walk(n, e)[1])], "node_id string, place long")


def reached(start: list[str], links: list[tuple[str, str]]) -> list[str]:
    """The nodes that start reaches over links (a, b), start included, in the order of a breadth-first search."""
    ahead: dict[str, list[str]] = {}
    for a, b in links:
        ahead.setdefault(a, []).append(b)
    seen = dict.fromkeys(start)
    queue = list(seen)
    for node in queue:
        for to in ahead.get(node, ()):
            if to not in seen:
                seen[to] = None
                queue.append(to)
    return queue


def reach(start: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(flow_id, node_id) reachable from start. A flow's start and edges are two arrays of one row, walked once."""
    s = start.groupBy("flow_id").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"))
    e = edges.groupBy("flow_id").agg(F.collect_list(F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"))).alias("edges"))

    def batches(frames):
        for pdf in frames:
            links = [[] if x is None else [(y["src"], y["dst"]) for y in x] for x in pdf["edges"]]
            rows = [(f, n) for f, own, x in zip(pdf["flow_id"], pdf["nodes"], links, strict=True) for n in reached(list(own), x)]
            yield type(pdf)(rows, columns=["flow_id", "node_id"])

    return s.join(e, "flow_id", "left").mapInPandas(batches, f"flow_id {start.schema['flow_id'].dataType.simpleString()}, node_id string")


def reachable(nodes: DataFrame, forward_edges: DataFrame) -> DataFrame:
    """GRF-4: nodes that the roots reach over forward edges."""
    return reach(roots(nodes, forward_edges), forward_edges)


def reaches(nodes: DataFrame, edges: DataFrame, type_: str = "return") -> DataFrame:
    """GRF-5: nodes that reach a node of the type, back edges included."""
    return reach(nodes.filter(F.col("type") == type_).select("flow_id", "node_id"), edges, "dst", "src")


def route(df: DataFrame, branches: dict[str, Column], errors: dict[str, Column] | None = None) -> DataFrame:
    """GRF-10: one row per satisfied branch, from one scan; None is always satisfied.

    errors holds, by branch, why its condition has no value (null or '': it has one). A step with such a
    branch fails: it takes no branch, and comes out once, with a null branch and the first error in `error`.
    """
    arms = F.array(*(F.struct(F.lit(k).alias("branch"), (F.lit(True) if cond is None else F.coalesce(cond, F.lit(False))).alias("go")) for k, cond in branches.items()))
    taken = F.filter(arms, lambda a: a["go"])
    if not errors:
        return df.select("*", F.explode(taken).alias("__arm")).select(*df.columns, F.col("__arm.branch").alias("branch"))
    first = F.coalesce(*(F.nullif(errors[k], F.lit("")) for k in branches if k in errors), F.lit(""))
    failed = F.array(F.struct(F.lit(None).cast("string").alias("branch"), F.lit(True).alias("go")))
    out = df.select("*", first.alias("__error"), F.explode(F.when(first == "", taken).otherwise(failed)).alias("__arm"))
    return out.select(*df.columns, F.col("__arm.branch").alias("branch"), F.col("__error").alias("error"))


def routed_hops(hops: DataFrame) -> DataFrame:
    """GRF-10 over recorded hops: those that fire."""
    return loop_first(hops).filter("fires")


def frontier_report(nodes: DataFrame, forward_edges: DataFrame, states: DataFrame, waits: DataFrame | None = None) -> DataFrame:
    """GRF-11: what each step of a stalled case is.

    A step with a state other than pending keeps it. Others are waiting (a parked wait of waits), ready (no
    parent, or all completed), skipped (a join, of several incoming edges, with a failed or skipped parent),
    orphaned (activated, that is with a pending state, where nothing failed), or blocked.
    """
    s = states.select(F.col("run_id").alias("flow_id"), "node_id", "status")
    parked = states.select(F.col("run_id").alias("flow_id"), "node_id").limit(0) if waits is None else waits.select(F.col("run_id").alias("flow_id"), "node_id")
    parked = parked.distinct().withColumn("parked", F.lit(True))
    broken = s.groupBy("flow_id").agg(F.bool_or(F.col("status") == "failed").alias("any_failure"))
    parents = forward_edges.select("flow_id", F.col("src").alias("parent"), F.col("dst").alias("node_id"))
    p = parents.join(s.withColumnsRenamed({"node_id": "parent", "status": "parent_status"}), ["flow_id", "parent"], "left")
    p = p.groupBy("flow_id", "node_id").agg(
        F.count("*").alias("n_in"),
        F.bool_and(F.coalesce(F.col("parent_status") == "completed", F.lit(False))).alias("all_done"),
        F.bool_or(F.coalesce(F.col("parent_status").isin("failed", "skipped"), F.lit(False))).alias("any_failed"),
    )
    j = nodes.select("flow_id", "node_id").join(s, ["flow_id", "node_id"], "left").join(p, ["flow_id", "node_id"], "left")
    j = j.join(parked, ["flow_id", "node_id"], "left").join(broken, "flow_id", "left")
    state = (
        F.when(F.col("status") != "pending", F.col("status"))
        .when(F.col("parked"), "waiting")
        .when(F.col("n_in").isNull() | F.col("all_done"), "ready")
        .when(F.col("any_failed") & (F.col("n_in") > 1), "skipped")
        .when((F.col("status") == "pending") & ~F.coalesce("any_failure", F.lit(False)), "orphaned")
        .otherwise("blocked")
    )
    return j.select("flow_id", "node_id", state.alias("state"))


def suspending_nodes(nodes: DataFrame) -> DataFrame:
    """GRF-9: the steps of each flow that may suspend, sorted, from (flow_id, node_id, type, config JSON).

    await_signal always does; agent_loop when async; wait in any mode but sleep, or for longer than its inline
    cap: max_inline_seconds, where 0 or none means INLINE_CAP and a negative one 0. A wait whose config does
    not parse counts, an agent_loop's does not.
    """
    at = lambda k: F.get_json_object("config", f"$.{k}")
    number = lambda k: F.coalesce(at(k).try_cast("bigint"), F.lit(0))
    mode, cap = F.trim(F.coalesce(at("mode"), F.lit(""))), number("max_inline_seconds")
    cap = F.when(cap < 0, 0).when(cap == 0, INLINE_CAP).otherwise(cap)
    broken = F.try_parse_json(F.coalesce("config", F.lit("{}"))).isNull()
    waits = broken | ~mode.isin("", "sleep") | ((number("duration_seconds") > 0) & (number("duration_seconds") > cap))
    bad = (F.col("type") == "await_signal") | ((F.col("type") == "wait") & waits) | ((F.col("type") == "agent_loop") & F.coalesce(at("async") == "true", F.lit(False)))
    return nodes.filter(bad).groupBy("flow_id").agg(F.array_join(F.array_sort(F.collect_list("node_id")), ",").alias("offenders"))


@dataclass
class Policy:
    """What a definition made at run time may hold; 0 and an empty list are no limit."""

    max_nodes: int = 8
    max_edges: int = 12
    allowed: tuple[str, ...] = ("api_fetch", "cel_eval", "wait", "return")
    allow_agent_loop: bool = False
    max_total_time_seconds: int = 30
    max_total_tokens: int = 0


def policy_issues(nodes: DataFrame, edges: DataFrame, policy: Policy, budgets: DataFrame | None = None) -> DataFrame:
    """GRF-8: the first violation of each flow, '' for none: nodes, edges, then step by step in declared order agent_loop and
    other types, then the time and token budgets of budgets (flow_id, max_total_time_seconds, max_total_tokens), which must be set
    and within the policy."""
    allowed = [a.strip() for a in policy.allowed if a.strip()]
    agent = (F.col("type") == "agent_loop") & F.lit(not policy.allow_agent_loop)
    off = F.when(agent, "agent_loop is not allowed").when(F.lit(bool(allowed)) & ~F.col("type").isin(*allowed), F.concat(F.lit("type not allowed: "), "type"))
    n = nodes.groupBy("flow_id").agg(F.count("*").alias("n_nodes"), F.min(F.when(off.isNotNull(), F.struct(F.col("pos"), off.alias("off")))).alias("off"))
    e = edges.groupBy("flow_id").agg(F.count("*").alias("n_edges"))
    j = n.join(e, "flow_id", "left")
    if budgets is None:
        j = j.withColumns({"max_total_time_seconds": F.lit(0), "max_total_tokens": F.lit(0)})
    else:
        j = j.join(budgets.select("flow_id", "max_total_time_seconds", "max_total_tokens"), "flow_id", "left")
    over = lambda value, most: F.lit(most > 0) & ((F.coalesce(value, F.lit(0)) <= 0) | (F.coalesce(value, F.lit(0)) > most))
    violation = (
        F.when(F.lit(policy.max_nodes > 0) & (F.col("n_nodes") > policy.max_nodes), "too many nodes")
        .when(F.lit(policy.max_edges > 0) & (F.coalesce("n_edges", F.lit(0)) > policy.max_edges), "too many edges")
        .when(F.col("off").isNotNull(), F.col("off.off"))
        .when(over(F.col("max_total_time_seconds"), policy.max_total_time_seconds), f"max_total_time_seconds must be set and at most {policy.max_total_time_seconds}")
        .when(over(F.col("max_total_tokens"), policy.max_total_tokens), f"max_total_tokens must be set and at most {policy.max_total_tokens}")
        .otherwise("")
    )
    return j.select("flow_id", violation.alias("violation"))


#: Stages of the rules, in the order in which issues are listed.
WHOLE, NODE, EDGE, LOOP, CONTRACT, REFERENCE = range(6)


def issues_of(nodes: list[tuple[int, str, str]], edges: list[tuple[int, str, str, int]], known: set[str]) -> list[tuple[int, int, str, str, str]]:
    """(stage, position, code, target, message) of one flow's nodes (pos, id, type) and edges (pos, src, dst, max_traversals), in order."""
    out, ids = [], dict.fromkeys(n for _, n, _ in nodes)
    if len(nodes) > MAX_NODES:
        out.append((WHOLE, 0, "TOO_MANY_NODES", "", "too many nodes"))
    seen, arrows = set(), set()
    for pos, n, kind in nodes:
        if n in seen:
            out.append((NODE, pos, "DUPLICATE_NODE_ID", n, "node id is used before"))
        seen.add(n)
        if kind not in known:
            out.append((NODE, pos, "UNKNOWN_NODE_TYPE", n, "unknown type"))
    for pos, a, b, _ in edges:
        arrow = f"{a}->{b}"
        found = [("SELF_LOOP", "edge to its own node")] if a == b else []
        found += [("DUPLICATE_EDGE", "edge is declared before")] if arrow in arrows else []
        found += [("DANGLING_EDGE_SOURCE", "source is unknown")] if a not in ids else []
        found += [("DANGLING_EDGE_TARGET", "target is unknown")] if b not in ids else []
        arrows.add(arrow)
        out += [(EDGE, pos, code, arrow, message) for code, message in found]
    back = set(walk(list(ids), [e[:3] for e in edges])[0])
    out += [(LOOP, pos, "BACK_EDGE_MISSING_MAX_TRAVERSALS", f"{a}->{b}", "loop without a limit") for pos, a, b, m in edges if pos in back and m <= 0]
    # The contract of returns.
    returns, sources = {n for _, n, t in nodes if t == "return"}, {a for _, a, _, _ in edges}
    ahead = [(a, b) for pos, a, b, _ in edges if pos not in back]
    into = {b for _, b in ahead}
    roots = [n for n in ids if n not in into]
    contract = [] if returns else [("NO_RETURN_NODE", "", "no return")]
    contract += [] if roots else [("NO_ROOT", "", "no root")]
    first = set(reached(roots, ahead))
    contract += [("UNREACHABLE_NODE", n, "no root reaches it") for n in ids if n not in first]
    contract += [("RETURN_HAS_OUTGOING", n, "a return ends the run") for n in ids if n in returns and n in sources]
    contract += [("NON_RETURN_LEAF", n, "a leaf must be a return") for n in ids if n not in returns and n not in sources]
    if returns:
        ends = set(reached(sorted(returns), [(b, a) for _, a, b, _ in edges]))
        contract += [("NO_RETURN_PATH", n, "no path to a return") for n in ids if n not in ends]
    return out + [(CONTRACT, i, *c) for i, c in enumerate(contract)]


def structure_issues(nodes: DataFrame, edges: DataFrame, known_types: list[str]) -> DataFrame:
    """GRF-6: coded issues of the structure of flows from (flow_id, pos, node_id, type) and (flow_id, pos, src, dst, max_traversals).

    A flow's nodes and edges are two arrays of one row, and one walk over that row applies all rules, in time
    linear in the flow's size. stage and place give the order of the rules and the position that each looked at.
    """
    n = nodes.groupBy("flow_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id", "type"))).alias("n"))
    e = edges.groupBy("flow_id").agg(F.array_sort(F.collect_list(F.struct("pos", "src", "dst", "max_traversals"))).alias("e"))
    known = set(known_types)

    def batches(frames):
        for pdf in frames:
            rows = []
            for flow, own, links in zip(pdf["flow_id"], pdf["n"], pdf["e"], strict=True):
                links = [] if links is None else [(x["pos"], x["src"], x["dst"], x["max_traversals"]) for x in links]
                rows += [(flow, code, target, "error", message, stage, place) for stage, place, code, target, message in issues_of([(x["pos"], x["node_id"], x["type"]) for x in own], links, known)]
            yield type(pdf)(rows, columns=["flow_id", "code", "target", "severity", "message", "stage", "place"])

    schema = f"flow_id {nodes.schema['flow_id'].dataType.simpleString()}, code string, target string, severity string, message string, stage int, place long"
    return n.join(e, "flow_id", "left").mapInPandas(batches, schema)
