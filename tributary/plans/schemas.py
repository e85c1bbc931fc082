"""What this engine can do and what its documents look like, for programs that drive it."""

from __future__ import annotations

from tributary.operators.recipe import MAX_FIELDS, MAX_STEPS
from tributary.plans import documents, pipeline, sqlpolicy

_TEXT, _LIST, _OBJECT, _WHOLE = {"type": "string"}, {"type": "array"}, {"type": "object"}, {"type": "integer", "minimum": 0}


def _object(required: dict, optional: dict | None = None) -> dict:
    return {"type": "object", "additionalProperties": False, "required": sorted(required), "properties": {**required, **(optional or {})}}


def artifact_schemas() -> dict[str, dict]:
    """JSON schemas of the documents that are read and the records that are written."""
    step = {"oneOf": [_object({"op": {"const": op}, **{k: {} for k in need}}, {k: {} for k in may}) for op, (need, may) in sorted(documents.STEPS.items())]}
    return {
        "prepare-recipe": _object({"kind": {"const": "prepare"}, "schema_version": {"const": 1}, "source": _OBJECT, "output": _OBJECT, "id_field": _TEXT, "steps": {"type": "array", "maxItems": MAX_STEPS, "items": step}}, {"namespace": _TEXT, "generated_source_id": _TEXT}),
        "quality-policy": _object({"schema_version": {"const": 1}, "adapter": {"const": "jsonl"}, "mode": {"enum": ["full", "changed_only"]}, "fields": _OBJECT}, {"namespace": _TEXT, "policy_id": _TEXT}),
        "subset-view": _object({"schema_version": {"const": 1}}, {"predicates": _LIST, "sample": _OBJECT, "namespace": _TEXT, "adapter": _TEXT, "kind": _TEXT, "view_id": _TEXT}),
        "pipeline-config": _object({k: {} for k in ("schema_version", "pipeline", "target", "inputs", "transform", "export", "delivery")}, {"validate": _OBJECT, "consumers": _LIST}),
        "plan": _object({"spec": _OBJECT, "result": _OBJECT, "plan_id": _TEXT}),
        "receipt": _object({"plan_id": _TEXT, "output": _TEXT, "result": _OBJECT, "receipt_id": _TEXT}),
        "run-receipt": _object({"plan_id": _TEXT, "output": _TEXT, "bundle": _OBJECT, "records": _WHOLE, "receipt_id": _TEXT}),
        "consumption-plan": _object({"bundle": _TEXT, "split": _TEXT, "consumer": _TEXT, "shards": _LIST, "plan_id": _TEXT}),
        "consumption-receipt": _object({"plan_id": _TEXT, "split": _TEXT, "consumer": _TEXT, "shards": _WHOLE, "records": _WHOLE, "receipt_id": _TEXT}),
        "field-patch": _object({"rid": _TEXT, "field": _TEXT, "before": {}, "after": {}}),
    }


def capabilities() -> dict:
    """Commands, limits and vocabularies."""
    from tributary.__main__ import COMMANDS

    return {
        "commands": sorted(COMMANDS), "functions": sorted(sqlpolicy.FUNCTIONS), "cast_types": sorted(sqlpolicy.TYPES), "steps": sorted(documents.STEPS), "pipeline_phases": list(pipeline.PHASES),
        "limits": {"sql_bytes": sqlpolicy.MAX_BYTES, "sql_depth": sqlpolicy.MAX_DEPTH, "sql_parameters": sqlpolicy.MAX_PARAMS, "sql_inputs": sqlpolicy.MAX_INPUTS, "recipe_steps": MAX_STEPS, "recipe_fields": MAX_FIELDS},
        "schemas": sorted(artifact_schemas()),
    }


#: Where the guide is put in a repository.
GUIDE = "TRIBUTARY.md"


def guide() -> str:
    """How to drive the commands, for people and programs."""
    from tributary.__main__ import COMMANDS

    lines = [f"* `python -m tributary {name} {' '.join(a.upper() for a in arguments)}{''.join(f' [--{k.replace(chr(95), chr(45))}]' for k in flags)}`".rstrip() for name, (_, arguments, flags) in sorted(COMMANDS.items())]
    return "\n".join(["# Driving the engine", "", "Every command prints one JSON object; `error` with a code means that nothing was done.", "Plan first, show the plan, apply it by its id; a broken application is applied again.", "", *lines, ""])
