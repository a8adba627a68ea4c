"""Selecting from candidate plans: what a selector may see, strict replies, choices applied,
proposals admitted, and the states of a line.

A selection names candidates by id; whatever it leaves out stays as the base has it. Each
step is a function of one line and a column over lines; a fault of a reply is a value of the
row, never an exception of the job.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quire.operators.candidates import PLAN, Scores, Source, _cost, allowed, local_ok, source_of, supported

_FAULTS = (ValueError, KeyError, TypeError)


# ---------------------------------------------------------------- one line


def check_plan(plan: dict) -> None:
    """Spans in order, disjoint, not empty, true to the base, with unique ids."""
    at, ids = 0, set()
    for s in plan["spans"]:
        a, b = s["start"], s["end"]
        if type(a) is not int or type(b) is not int or not at <= a < b <= len(plan["base_text"]):
            raise ValueError(f"span {s['id']} is out of order or bounds")
        if plan["base_text"][a:b] != s["original"] or s["id"] in ids:
            raise ValueError(f"span {s['id']} doesn't fit its line")
        ids.add(s["id"])
        at = b


def candidate(span: dict, name: Any) -> dict:
    found = [c for c in span["candidates"] if c["id"] == name]
    if len(found) != 1:
        raise ValueError(f"{span['id']} has no candidate {name}")
    return found[0]


def apply_choices(plan: dict, choices: dict[str, str]) -> str:
    """The line with the chosen candidates in place, by offsets of the base."""
    check_plan(plan)
    if unknown := choices.keys() - {s["id"] for s in plan["spans"]}:
        raise ValueError(f"no span {min(unknown)}")
    parts, at = [], 0
    for s in plan["spans"]:
        text = s["original"]
        if s["id"] in choices:
            c = candidate(s, choices[s["id"]])
            text = c["text"]
            if text != s["original"] and not c.get("visual_support"):
                raise ValueError("a changed text needs a source that can show it")
            if not local_ok(s["original"], text, plan["alphabet"]):
                raise ValueError("a candidate breaks the limits of its span")
        parts += [plan["base_text"][at : s["start"]], text]
        at = s["end"]
    line = "".join(parts) + plan["base_text"][at:]
    if not allowed(line, plan["alphabet"]):
        raise ValueError("the line breaks the alphabet")
    return line


def _entries(data: dict, name: str, keys: set[str]) -> list[tuple]:
    """The members of a list of objects with exactly these keys, strings all."""
    if not isinstance(data[name], list):
        raise ValueError(f"{name} is a list")
    for x in data[name]:
        if not isinstance(x, dict) or x.keys() != keys or not all(isinstance(v, str) for v in x.values()):
            raise ValueError(f"{name} hold {' and '.join(sorted(keys))}")
    found = [tuple(x[k] for k in sorted(keys, reverse=True)) for x in data[name]]
    return found


def read_reply(raw: str, plan: dict, proposals: bool = True) -> tuple[dict[str, str], dict[str, str]]:
    """(choices, proposals) of a reply: one JSON object with exactly these two keys; one known
    candidate for each span; none that no source can show; at most one proposal a span, and
    none where they aren't asked for."""
    data = json.loads(raw)
    if not isinstance(data, dict) or data.keys() != {"choices", "proposals"}:
        raise ValueError("a reply has exactly choices and proposals")
    spans = {s["id"]: s for s in plan["spans"]}
    chosen: dict[str, str] = {}
    for span_id, candidate_id in _entries(data, "choices", {"span_id", "candidate_id"}):
        if span_id not in spans or span_id in chosen:
            raise ValueError("a choice is for a span of the plan, once")
        c = candidate(spans[span_id], candidate_id)
        if c["origin"] != "original" and c.get("visual_support") is False:
            raise ValueError("a choice names a candidate that isn't offered")
        chosen[span_id] = candidate_id
    if chosen.keys() != spans.keys():
        raise ValueError("every span needs a choice")
    wanted: dict[str, str] = {}
    for text, span_id in _entries(data, "proposals", {"span_id", "text"}):
        if not proposals or span_id not in spans or span_id in wanted:
            raise ValueError("a proposal is for a span of the plan, once, and not in the last round")
        wanted[span_id] = text
    return chosen, wanted


def refusal(plan: dict, span: dict, text: str, max_growth: int) -> str | None:
    """Why a proposed text can't stand in its span, evidence aside; None if it can."""
    n = len(span["original"])
    tests = {
        "blank_or_padded": not text.strip() or text != text.strip(),
        "alphabet": not allowed(text, plan["alphabet"]),
        "growth": len(text) > max(2 * n, n + max_growth),
        "local_limits": not local_ok(span["original"], text, plan["alphabet"]),
    }
    return next((reason for reason, fails in tests.items() if fails), None)


def admit(plan: dict, wanted: dict[str, str], sources: list[Source], max_growth: int = 12) -> tuple[list[dict], list[dict]]:
    """Add proposed texts to the plan: (accepted, rejected with a reason). Known texts are
    passed over; the others need a source that can show the whole line."""
    accepted, rejected = [], []
    scores = Scores(sources)
    for s in plan["spans"]:
        text = wanted.get(s["id"])
        if text is None or any(c["text"] == text for c in s["candidates"]):
            continue
        reason, told = refusal(plan, s, text, max_growth), {}
        if reason is None:
            (told,) = scores.of([plan["base_text"][: s["start"]] + text + plan["base_text"][s["end"] :]])
            reason = None if supported(told) else "no_visual_support"
        if reason:
            rejected.append({"span_id": s["id"], "text": text, "reason": reason})
            continue
        name = f"c{len(s['candidates'])}"
        s["candidates"].append({"id": name, "text": text, "origin": "qwen_proposal", "edit_cost": _cost(s["original"], text), "scores": told, "visual_support": True})
        accepted.append({"span_id": s["id"], "candidate_id": name})
    return accepted, rejected


def offered(plan: dict) -> dict:
    """What a selector may see: texts, origins and scores of candidates that some source can
    show; nothing else of the record, so that no truth can leak."""

    def seen(c: dict) -> bool:
        return c["origin"] == "original" or c.get("visual_support") is not False

    spans = [{"id": s["id"], "original": s["original"], "candidates": [{k: c[k] for k in ("id", "text", "origin", "edit_cost", "scores")} for c in s["candidates"] if seen(c)]} for s in plan["spans"]]
    return {"base_text": plan["base_text"], "spans": spans}


def recover_line(plan: dict, sources: list[Source], ask: Callable[[str], dict], template: str = "", context: list[str] | None = None, max_growth: int = 12) -> dict:
    """Run the selection of a line: one round, and a second where proposals were admitted. A
    failed second round keeps the first with a flag; any other failure keeps the base text."""
    done: dict[str, Any] = {"text": plan["base_text"], "status": "error", "flags": [], "error": None, "final_selection_error": None, "choices": {}, "accepted_proposals": [], "rejected_proposals": [], "final_scores": {}}

    def turn(last: bool) -> tuple[str, dict[str, str], dict[str, str]]:
        reply = ask(template + json.dumps(offered(plan) | {"context": context or [], "final": last}, ensure_ascii=False))
        if reply.get("status") != "ok":
            raise ValueError(f"selector: {reply.get('status')}")
        choices, wanted = read_reply(reply["raw"], plan, proposals=not last)
        return apply_choices(plan, choices), choices, wanted

    try:
        if not plan["spans"]:
            raise ValueError("a line without spans can't be selected from")
        done["text"], done["choices"], wanted = turn(False)
        done["accepted_proposals"], done["rejected_proposals"] = admit(plan, wanted, sources, max_growth)
        if done["rejected_proposals"]:
            done["flags"].append("rejected_proposals")
        if done["accepted_proposals"]:
            try:
                done["text"], done["choices"], _ = turn(True)
            except _FAULTS as e:
                done["flags"].append("final_selection_failed")
                done["final_selection_error"] = str(e)
        (done["final_scores"],) = Scores(sources).of([done["text"]])
        if sources and not supported(done["final_scores"]):
            done["flags"].append("no_feasible_source")
        done["status"] = "review" if done["flags"] else "ok"
    except _FAULTS as e:
        done |= {"text": plan["base_text"], "status": "error", "error": str(e), "choices": {}}
    return done


# ---------------------------------------------------------------- columns

_S = T.StringType()
_PAIRS = T.MapType(_S, _S)
REPLY = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("error", _S), T.StructField("choices", _PAIRS), T.StructField("proposals", _PAIRS)])
APPLIED = T.StructType([T.StructField("text", _S), T.StructField("error", _S)])
ACCEPTED = T.ArrayType(T.StructType([T.StructField("span_id", _S), T.StructField("candidate_id", _S)]))
REJECTED = T.ArrayType(T.StructType([T.StructField("span_id", _S), T.StructField("text", _S), T.StructField("reason", _S)]))
ADMITTED = T.StructType([T.StructField("plan", PLAN), T.StructField("accepted", ACCEPTED), T.StructField("rejected", REJECTED)])
SCORES = T.MapType(_S, T.DoubleType())
LINE = T.StructType(
    [
        T.StructField("text", _S), T.StructField("status", _S), T.StructField("flags", T.ArrayType(_S)), T.StructField("error", _S), T.StructField("final_selection_error", _S), T.StructField("choices", _PAIRS),
        T.StructField("accepted_proposals", ACCEPTED), T.StructField("rejected_proposals", REJECTED), T.StructField("final_scores", SCORES),
    ]
)


def _plan_of(row: dict) -> dict:
    """A plan as the functions of one line take it; maps come from Arrow as lists of pairs."""
    spans = [s | {"candidates": [c | {"scores": dict(c["scores"] or [])} for c in s["candidates"] or []]} for s in row["spans"] or []]
    return row | {"base_text": row["base_text"] or "", "spans": spans}


def _plan_out(plan: dict) -> dict:
    return plan | {"spans": [s | {"candidates": [c | {"scores": list(c["scores"].items())} for c in s["candidates"]]} for s in plan["spans"]]}


def _rows(kind: T.DataType, function: Callable[..., Any], *columns: Column) -> Column:
    """A column of what `function` makes of each row's values; null where the first is null."""
    arrow = to_arrow_type(kind)

    def each(*arrays: pa.Array) -> pa.Array:
        rows = zip(*(a.to_pylist() for a in arrays))
        return pa.array([None if r[0] is None else function(*r) for r in rows], arrow)

    # The number of arguments must show in the signature.
    one, two, three = (lambda a: each(a)), (lambda a, b: each(a, b)), (lambda a, b, c: each(a, b, c))
    chosen = {1: one, 2: two, 3: three}[len(columns)]
    chosen.__annotations__ = dict.fromkeys("abc"[: len(columns)], pa.Array) | {"return": pa.Array}
    return F.arrow_udf(chosen, kind)(*columns)


def offers(plan: Column) -> Column:
    """The JSON that a selector is shown of a plan (offered)."""
    return _rows(_S, lambda p: json.dumps(offered(_plan_of(p)), ensure_ascii=False, sort_keys=True), plan)


def replies(raw: Column, plan: Column, proposals: bool = True) -> Column:
    """REPLY structs: what read_reply finds, or its error."""

    def read(text: str, p: dict | None) -> dict:
        try:
            if p is None:
                raise ValueError("a reply without a plan")
            choices, wanted = read_reply(text, _plan_of(p), proposals)
            return {"ok": True, "error": None, "choices": list(choices.items()), "proposals": list(wanted.items())}
        except _FAULTS as e:
            return {"ok": False, "error": str(e), "choices": None, "proposals": None}

    return _rows(REPLY, read, raw, plan)


def applied(plan: Column, choices: Column) -> Column:
    """APPLIED structs: the line with a map of choices applied, or why it can't be."""

    def put(p: dict, c: list | None) -> dict:
        try:
            return {"text": apply_choices(_plan_of(p), dict(c or [])), "error": None}
        except _FAULTS as e:
            return {"text": None, "error": str(e)}

    return _rows(APPLIED, put, plan, choices)


def admitted(plan: Column, proposals: Column, sources: Column, max_growth: int = 12) -> Column:
    """ADMITTED structs: the plan with the proposals that were accepted, and all verdicts."""

    def add(p: dict, wanted: list | None, rows: list | None) -> dict:
        plan_ = _plan_of(p)
        accepted, rejected = admit(plan_, dict(wanted or []), [source_of(r) for r in rows or []], max_growth)
        return {"plan": _plan_out(plan_), "accepted": accepted, "rejected": rejected}

    return _rows(ADMITTED, add, plan, proposals, sources)


def final_scores(text: Column, sources: Column) -> Column:
    """Map from source key to the log probability of a whole line; null where it is none."""
    return _rows(SCORES, lambda t, rows: list(Scores([source_of(r) for r in rows or []]).of([t])[0].items()), text, sources)


def recover(lines: DataFrame, make: Callable[[], Callable[[str], dict]], template: str = "", max_growth: int = 12) -> DataFrame:
    """`lines` (plan, sources, context and any others) plus `line`, a LINE struct: the states
    of recover_line with a selector that is made once a worker."""
    kind = to_arrow_type(LINE)
    made: list[Callable[[str], dict]] = []

    @F.arrow_udf(LINE)
    def run(plans_: pa.Array, sources: pa.Array, contexts: pa.Array) -> pa.Array:
        if not made:
            made.append(make())
        out = []
        for p, rows, near in zip(plans_.to_pylist(), sources.to_pylist(), contexts.to_pylist()):
            done = recover_line(_plan_of(p), [source_of(r) for r in rows or []], made[0], template, near, max_growth)
            out.append(done | {k: list(done[k].items()) for k in ("choices", "final_scores")})
        return pa.array(out, kind)

    return lines.withColumn("line", run("plan", "sources", "context"))
