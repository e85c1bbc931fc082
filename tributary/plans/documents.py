"""Documents that people write: recipes, quality policies, subset views (JSON) and pipelines (YAML), read strictly.

Unknown and repeated keys are errors, so is anything that a later step could
only misread; what comes out are the plain values the operators take.
"""

from __future__ import annotations

import json
import re

from tributary.operators.policy import validate
from tributary.operators.recipe import MAX_STEPS
from tributary.operators.views import MAX_CLAUSES, MAX_VALUES
from tributary.operators.export import split_units

MAX_DOCUMENT = 1 << 20
#: What each operation of a recipe must and may say.
STEPS = {
    "filter": ({"field", "predicate", "value"}, set()), "select": ({"fields"}, set()), "rename": ({"from", "to"}, set()), "cast": ({"field", "type"}, set()), "trim": ({"fields"}, set()), "case": ({"fields", "mode"}, set()),
    "replace": ({"field", "from", "to"}, set()), "fill_missing": ({"fields", "value"}, set()), "drop_missing": ({"fields"}, {"mode"}), "dedupe": ({"by"}, {"keep"}),
}
CHOICES = {"predicate": ("eq", "ne", "lt", "lte", "gt", "gte"), "type": ("string", "integer", "number", "boolean"), "mode": ("lower", "upper", "any", "all"), "keep": ("first", "error")}


class DocumentError(ValueError):
    """A document that can't be taken as meant."""


def _no_repeats(pairs):
    out = {}
    for k, v in pairs:
        if k in out:
            raise DocumentError(f"{k} is repeated")
        out[k] = v
    return out


def _refuse(name):
    raise DocumentError(f"{name} is no number")


def parse_json(text: str) -> dict:
    """A JSON object without repeated keys or numbers that JSON does not have."""
    if len(text.encode()) > MAX_DOCUMENT:
        raise DocumentError("the document is too large")
    try:
        found = json.loads(text, object_pairs_hook=_no_repeats, parse_constant=_refuse)
    except json.JSONDecodeError as e:
        raise DocumentError(str(e)) from None
    if not isinstance(found, dict):
        raise DocumentError("an object is expected")
    return found


def keys(found, need: set, may: set, what: str) -> dict:
    if not isinstance(found, dict):
        raise DocumentError(f"{what} must be an object")
    for k in need - set(found):
        raise DocumentError(f"{what} needs {k}")
    for k in set(found) - need - may:
        raise DocumentError(f"{what} knows no {k}")
    return found


def _names(x, what: str) -> list[str]:
    if not isinstance(x, list) or not x or any(not isinstance(n, str) or not n for n in x) or len(set(x)) != len(x):
        raise DocumentError(f"{what} must list different names")
    return x


def parse_recipe(text: str) -> dict:
    """source (format, delimiter, include, ignore), id_field, generated_source_id, steps as operators.recipe takes them."""
    found = keys(parse_json(text), {"kind", "schema_version", "source", "output", "id_field", "steps"}, {"namespace", "generated_source_id"}, "recipe")
    if found["kind"] != "prepare" or found["schema_version"] != 1 or found["output"] != {"format": "jsonl"}:
        raise DocumentError("not a recipe of this version")
    kind = found["source"].get("format") if isinstance(found["source"], dict) else None
    source = keys(found["source"], {"format"}, {"include", "ignore"} | ({"delimiter"} if kind == "csv" else set()), "source")
    if kind not in ("csv", "parquet", "jsonl"):
        raise DocumentError(f"no format {kind}")
    for k in ("include", "ignore"):
        if source.get(k):
            _names(source[k], k)
    if len(source.get("delimiter", ",").encode()) != 1:
        raise DocumentError("the delimiter is one ASCII character")
    if not isinstance(found["id_field"], str) or not found["id_field"]:
        raise DocumentError("id_field must be a name")
    if not isinstance(found["steps"], list) or len(found["steps"]) > MAX_STEPS:
        raise DocumentError(f"steps must be a list of at most {MAX_STEPS}")
    steps = [_step(x, k) for k, x in enumerate(found["steps"], 1)]
    return {"source": source, "id_field": found["id_field"], "generated_source_id": found.get("generated_source_id"), "steps": steps}


def _step(x, number: int) -> dict:
    what = f"step {number}"
    if not isinstance(x, dict) or x.get("op") not in STEPS:
        raise DocumentError(f"{what}: no such operation")
    need, may = STEPS[x["op"]]
    x = dict(keys(x, need | {"op"}, may, what))
    for k, allowed in CHOICES.items():
        if k in x and x[k] not in allowed:
            raise DocumentError(f"{what}: {k} is one of {', '.join(allowed)}")
    for k in ("fields", "by"):
        if k in x:
            _names(x[k], f"{what}: {k}")
    if x["op"] == "cast":
        x["to"] = x.pop("type")
    if x["op"] == "fill_missing":
        x["op"] = "fill"
    return x


def parse_policy(text: str) -> dict:
    """mode (full, changed_only) and rules as operators.policy takes them."""
    found = keys(parse_json(text), {"schema_version", "adapter", "mode", "fields"}, {"namespace", "policy_id"}, "policy")
    if found["schema_version"] != 1 or found["adapter"] != "jsonl" or found["mode"] not in ("full", "changed_only"):
        raise DocumentError("not a policy of this version")
    rules = {}
    for name, r in found["fields"].items():
        r = keys(r, set(), {"required", "nullable", "types", "enum", "minimum", "maximum", "pattern", "unique"}, name)
        rule = {k: r[k] for k in ("required", "nullable", "enum", "pattern", "unique") if k in r}
        if r.get("types"):
            rule["type"] = r["types"][0] if len(r["types"]) == 1 else tuple(r["types"])
        rule |= {short: r[long] for long, short in (("minimum", "min"), ("maximum", "max")) if long in r}
        rules[name] = rule
    try:
        validate(rules)
    except ValueError as e:
        raise DocumentError(str(e)) from None
    return {"mode": found["mode"], "rules": rules}


def parse_view(text: str) -> dict:
    """clauses as operators.views.subset takes them, sample (rate, seed) or None."""
    found = keys(parse_json(text), {"schema_version"}, {"namespace", "adapter", "kind", "predicates", "sample", "view_id"}, "view")
    clauses = []
    for x in found.get("predicates", []):
        x = keys(x, {"field", "op"}, {"value", "values"}, "predicate")
        if x["op"] in ("exists", "missing", "is_null"):
            keys(x, {"field", "op"}, set(), "predicate")
            clauses.append((x["field"], x["op"]))
        elif x["op"] == "in":
            values = x.get("values", x.get("value"))
            if not isinstance(values, list) or not 0 < len(values) <= MAX_VALUES or any(isinstance(v, (list, dict)) for v in values):
                raise DocumentError(f"in takes 1 to {MAX_VALUES} scalars")
            clauses.append((x["field"], "in", values))
        elif x["op"] in ("eq", "lt", "lte", "gt", "gte"):
            if "value" not in x or isinstance(x["value"], (list, dict)) or (x["op"] != "eq" and (isinstance(x["value"], bool) or not isinstance(x["value"], (int, float)))):
                raise DocumentError(f"{x['op']} takes a {'scalar' if x['op'] == 'eq' else 'number'}")
            clauses.append((x["field"], x["op"], x["value"]))
        else:
            raise DocumentError(f"no test {x['op']}")
    if len(clauses) > MAX_CLAUSES:
        raise DocumentError(f"at most {MAX_CLAUSES} predicates")
    sample = found.get("sample")
    if sample is not None:
        sample = keys(sample, {"rate_bps", "seed"}, set(), "sample")
        if not isinstance(sample["rate_bps"], int) or not 1 <= sample["rate_bps"] <= 10_000 or not isinstance(sample["seed"], str):
            raise DocumentError("rate_bps is 1 to 10000, seed a text")
    return {"clauses": clauses, "sample": sample and (sample["rate_bps"], sample["seed"])}


def parse_yaml(text: str) -> dict:
    """YAML that says no more than JSON could: no anchors, aliases, tags, timestamps or repeated keys."""
    try:
        import yaml
    except ImportError as e:
        raise DocumentError("YAML needs the yaml package") from e
    if len(text.encode()) > MAX_DOCUMENT:
        raise DocumentError("the document is too large")
    plain = {f"tag:yaml.org,2002:{t}" for t in ("map", "seq", "str", "int", "float", "bool", "null")}

    def check(node) -> None:
        if node.tag not in plain:
            raise DocumentError(f"{node.tag.rpartition(':')[2]} is not allowed, quote it")
        if isinstance(node, yaml.MappingNode):
            names = [k.value for k, _ in node.value]
            for n in names:
                if names.count(n) > 1:
                    raise DocumentError(f"{n} is repeated")
            for k, v in node.value:
                if k.tag != "tag:yaml.org,2002:str":
                    raise DocumentError("keys are texts")
                check(v)
        elif isinstance(node, yaml.SequenceNode):
            for v in node.value:
                check(v)

    try:
        for token in yaml.scan(text):
            if isinstance(token, (yaml.tokens.AliasToken, yaml.tokens.AnchorToken, yaml.tokens.TagToken)):
                raise DocumentError("anchors, aliases and tags are not allowed")
        root = yaml.compose(text, Loader=yaml.SafeLoader)
        if root is None:
            raise DocumentError("an object is expected")
        check(root)
        found = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise DocumentError(str(e).split("\n")[0]) from None
    if not isinstance(found, dict):
        raise DocumentError("an object is expected")
    return found


_ALIAS, _NAME = re.compile(r"[a-z][a-z0-9_]{0,63}"), re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}")


def parse_pipeline(text: str) -> dict:
    """name, target (dataset, state, mode), inputs (alias, path, format), transform (sql, id_field, params), policy or None, export (weights, seed, max_records, max_bytes), output."""
    found = keys(parse_yaml(text), {"schema_version", "pipeline", "target", "inputs", "transform", "export", "delivery"}, {"validate", "consumers"}, "pipeline file")
    if found["schema_version"] != 1:
        raise DocumentError("schema_version must be 1")
    name = keys(found["pipeline"], {"name"}, {"provider"}, "pipeline")["name"]
    target = keys(found["target"], {"dataset", "state", "mode"}, set(), "target")
    if not isinstance(name, str) or not _NAME.fullmatch(name) or target["mode"] not in ("create", "update"):
        raise DocumentError("name or target.mode")
    inputs = found["inputs"]
    if not isinstance(inputs, list) or not 1 <= len(inputs) <= 16:
        raise DocumentError("1 to 16 inputs")
    for x in inputs:
        keys(x, {"alias", "path", "format"}, set(), "input")
        if not _ALIAS.fullmatch(str(x["alias"])) or x["format"] not in ("csv", "parquet", "jsonl"):
            raise DocumentError(f"input {x['alias']}")
    if len({x["alias"] for x in inputs}) != len(inputs):
        raise DocumentError("aliases must differ")
    transform = keys(found["transform"], {"sql", "id_field"}, {"params"}, "transform")
    export = keys(found["export"], {"split"}, {"max_shard_records", "max_shard_bytes", "seed"}, "export")
    weights = {}
    for part in _names(export["split"], "split"):
        split, _, weight = part.partition("=")
        if not _NAME.fullmatch(split) or not weight.isdigit() or split in weights:
            raise DocumentError(f"split {part}")
        weights[split] = int(weight)
    try:
        split_units(weights)
    except ValueError as e:
        raise DocumentError(str(e)) from None
    sizes = {k: export.get(k, d) for k, d in (("max_shard_records", 10_000), ("max_shard_bytes", 256 << 20))}
    if any(isinstance(v, bool) or not isinstance(v, int) or v < 1 for v in sizes.values()):
        raise DocumentError("shard bounds are positive whole numbers")
    policy = keys(found.get("validate") or {}, set(), {"quality_policy"}, "validate").get("quality_policy")
    return {
        "name": name, "target": target, "inputs": inputs, "transform": {"params": [], **transform}, "policy": parse_policy(json.dumps(policy)) if isinstance(policy, dict) else policy,
        "export": {"weights": weights, "seed": str(export.get("seed", "0")), "max_records": sizes["max_shard_records"], "max_bytes": sizes["max_shard_bytes"]}, "output": keys(found["delivery"], {"output"}, set(), "delivery")["output"],
    }
