"""Vocabulary of rule classes and attributes, and trace semantics, with JSON extensions.

Names of classes and attributes are compared by case folding. A class is known by its whole name or by its last part.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace
from pathlib import Path

# Concepts and the attribute names that hold them, in order of precedence.
ALIASES: dict[str, tuple[str, ...]] = {
    "source": ("IRISSource", "SourceName", "Source", "DataSourceName"),
    "method": ("HTTPMethod", "Action", "IRISAction"),
    "path": ("ResourcePath", "OperationPath", "RelativePath", "IRISPath", "Path", "URL", "Uri", "Endpoint"),
    "base_url": ("ServiceRootUri", "EndPointURL", "BaseURL", "BaseUri", "Endpoint"),
    "filter": ("Filter", "IRISFilter", "FilterDataItem", "Query"),
    "request": ("QueryInputDataGroup", "RequestDataGroup", "InputDataGroup", "Input"),
    "target": ("TargetDataGroup",),
    "result": ("ResultsDataGroup", "ResultDataGroup"),
    "output": ("OutputDataGroup", "Output"),
    "payload": ("Payload",),
    "error_code": ("HttpCodeDataItem", "ErrorCodeDataItem"),
    "error_message": ("HttpMessageDataItem", "ErrorMsgDataItem"),
    "context": (),
    "header_name": ("HTTPHeaderName",),
    "header_value": ("HTTPHeaderValue",),
    "language": ("AcceptLanguage",),
    "selector": ("SelectComponent", "ComponentList", "Component", "ComponentName", "ComponentPath", "CallComponent", "TargetComponent", "Source", "SourceName"),
}
# Classes that are known without configuration.
API_CLASSES = ("InvokeIRISRule", "SwaggerIntegrationRule")
COMPONENT_CLASSES = ("CallComponentRule", "BroadcastRule")
OTHER_CLASSES = ("CompareMultiListValuesRule", "ContainerRule", "EvaluateRule", "ExpressionRule", "GotoRule", "RepeatRule", "SetValueRule", "AssignRule")
# Attributes that contracts keep besides the aliases, and endings of flattened mapping attributes.
KEPT_ATTRIBUTES = (
    "eid", "Name", "RuleClassName", "ClassType", "RuleType", "RuleDisabled", "SelectComponent", "ComponentList", "Component", "ComponentName",
    "ComponentPath", "CallComponent", "TargetComponent", "Source", "SourceName", "IRISSource", "IRISAction", "Action", "HttpMethod", "URL",
    "Uri", "Endpoint", "EndPointURL", "BaseURL", "BaseUri", "ServiceRootUri", "Path", "ResourcePath", "OperationPath", "RelativePath",
    "IRISPath", "Filter", "IRISFilter", "FilterDataItem", "Query", "TargetDataGroup", "ResultsDataGroup", "ResultDataGroup",
    "QueryInputDataGroup", "RequestDataGroup", "InputDataGroup", "OutputDataGroup", "Input", "Output", "InputDataItem",
    "AdditionalHTTPDataGroups", "ErrorCodeDataItem", "ErrorMsgDataItem", "DataSourceName", "MappingSetName",
)
MAPPING_SUFFIXES = ("_ClassType", "_SolutionDataItemMapping", "_DataItemMapping", "_ExportedProperty", "_PropertyKey", "_In", "_Out", "_PubIn", "_PubOut", "_readMapping", "_writeMapping", "_Mapping")
KEPT_ENDINGS = ("url", "uri", "path", "method", "source", "component", "module", "selector", "reference")
# Rule kinds that a trace understands, and the attributes they are described by.
KINDS = {
    "ContainerRule": "container", "EvaluateRule": "evaluate", "SetValueRule": "set", "ExpressionRule": "expression", "RepeatRule": "repeat",
    "IncrementorRule": "increment", "ResetDataRule": "reset", "CallComponentRule": "call", "GotoRule": "goto",
}
TRACE_ATTRIBUTES = (
    "Expression", "OutputProperty", "Type", "FromType", "PropertyName", "VariableName", "PropertyGroupName", "PropertyGroupInstanceName",
    "FromPropertyName", "FromVariableName", "FromPropertyGroupName", "FromPropertyGroupInstanceName", "FromValue", "ResetProperty",
    "ResetPropertyGroup", "ResetVariable", "IncrementBy", "EndInstance", "DataGroupName", "Phase", "OperationType", "SelectComponent", "Trim",
    "ComponentList", "Source", "LinkReference", "RuleDisabled",
)
BRANCHES = {"True": True, "False": False}


class ConfigError(ValueError):
    pass


def suffix(name: str | None) -> str:
    return (name or "").rpartition(".")[2]


def fold(name: str | None) -> str:
    return (name or "").strip().casefold()


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


def _texts(value, what: str, empty: bool = True) -> list[str]:
    _need(isinstance(value, list) and all(isinstance(x, str) for x in value), f"{what} must be a JSON string array")
    _need(empty or (bool(value) and all(value)), f"{what} must be a non-empty string array")
    return value


def _object(value, what: str) -> dict:
    _need(isinstance(value, dict), f"{what} must be a JSON object")
    return value


class _Once(dict):
    """Folded class name -> value; a name that folds to one seen before is an error."""

    def __init__(self, what: str, exact: bool):
        super().__init__()
        self.what, self.exact, self.said = what, exact, {}

    def put(self, name, value) -> None:
        _need(isinstance(name, str) and bool(name.strip()), f"{self.what} must contain non-empty class names")
        _need(not self.exact or "." in name, f"{self.what} requires qualified class names")
        key = fold(name if self.exact else suffix(name))
        _need(key not in self, f"{self.what} contains duplicate normalized class names: {self.said.get(key)!r}, {name!r}")
        self[key], self.said[key] = value, name


@dataclass(frozen=True)
class Vocabulary:
    """Classes by folded name, with the spelling they were declared in; attributes by concept."""

    api: dict[str, str] = field(default_factory=lambda: {c.casefold(): c for c in API_CLASSES})
    api_exact: dict[str, str] = field(default_factory=dict)
    component: dict[str, str] = field(default_factory=lambda: {c.casefold(): c for c in COMPONENT_CLASSES})
    other: dict[str, str] = field(default_factory=lambda: {c.casefold(): c for c in OTHER_CLASSES})
    aliases: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(ALIASES))
    methods: dict[str, str] = field(default_factory=dict)
    methods_exact: dict[str, str] = field(default_factory=dict)
    attributes: dict[str, dict] = field(default_factory=dict)
    attributes_exact: dict[str, dict] = field(default_factory=dict)
    overrides: dict[str, dict] = field(default_factory=dict)
    overrides_exact: dict[str, dict] = field(default_factory=dict)

    @staticmethod
    def _match(name: str | None, exact: dict, by_suffix: dict) -> tuple[str, str] | None:
        """('exact' or 'suffix', key), the whole name first."""
        full = fold(name)
        if full and full in exact:
            return "exact", full
        last = suffix(full)
        return ("suffix", last) if last and last in by_suffix else None

    def api_match(self, name: str | None) -> dict | None:
        got = self._match(name, self.api_exact, self.api)
        return {"match": got[0], "key": got[1]} if got else None

    def method_match(self, name: str | None) -> dict | None:
        got = self._match(name, self.methods_exact, self.methods)
        return got and {"method": (self.methods_exact if got[0] == "exact" else self.methods)[got[1]], "match": got[0], "key": got[1]}

    def is_component(self, name: str | None) -> bool:
        return suffix(name).casefold() in self.component

    def is_known(self, name: str | None) -> bool:
        return bool(self.api_match(name)) or suffix(name).casefold() in self.component.keys() | self.other.keys()

    def _declared(self, name: str | None, concept: str, exact: dict, by_suffix: dict) -> tuple | None:
        full = fold(name)
        for table, key in ((exact, full), (by_suffix, suffix(full))):
            if concept in table.get(key, {}):
                return table[key][concept]
        return None

    def names(self, concept: str, rule_class: str | None = None) -> tuple[str, ...]:
        """Attribute names of a concept: a class's overrides, the aliases, then the class's additions."""
        first = self._declared(rule_class, concept, self.overrides_exact, self.overrides) or ()
        last = self._declared(rule_class, concept, self.attributes_exact, self.attributes) or ()
        return tuple(dict.fromkeys((*first, *self.aliases.get(concept, ()), *last)))

    def overridden(self, rule_class: str | None, concept: str) -> bool:
        return self._declared(rule_class, concept, self.overrides_exact, self.overrides) is not None

    def all_names(self) -> frozenset[str]:
        """Folded names of every attribute that some concept may read."""
        tables = (self.attributes, self.attributes_exact, self.overrides, self.overrides_exact)
        more = (n for t in tables for concepts in t.values() for names in concepts.values() for n in names)
        return frozenset(n.casefold() for n in (*(n for names in self.aliases.values() for n in names), *more))

    def keeps(self, name: str) -> bool:
        """Whether contracts keep an attribute."""
        low = name.casefold()
        return low in _KEPT or low in self.all_names() or low.endswith(_ENDINGS)

    def payload(self) -> dict:
        tables = lambda t: {c: {k: list(v) for k, v in sorted(x.items())} for c, x in sorted(t.items())}
        return {
            "api_rule_classes": sorted(self.api.values()), "api_rule_classes_exact": sorted(self.api_exact.values()),
            "component_rule_classes": sorted(self.component.values()), "non_api_rule_classes": sorted(self.other.values()),
            "aliases": {k: list(v) for k, v in sorted(self.aliases.items())},
            "method_by_rule_class_suffix": dict(sorted(self.methods.items())), "method_by_rule_class": dict(sorted(self.methods_exact.items())),
            "api_rule_attributes": tables(self.attributes), "api_rule_attributes_exact": tables(self.attributes_exact),
            "api_rule_attribute_overrides": tables(self.overrides), "api_rule_attribute_overrides_exact": tables(self.overrides_exact),
        }

    def signature(self) -> str:
        return hashlib.sha256(json.dumps(self.payload(), sort_keys=True).encode()).hexdigest()


_KEPT = frozenset(n.casefold() for n in KEPT_ATTRIBUTES)
_ENDINGS = tuple(s.casefold() for s in (*MAPPING_SUFFIXES, *KEPT_ENDINGS))


def read_config(path: str | Path | None) -> dict:
    if path is None:
        return {}
    try:
        got = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, json.JSONDecodeError) as e:
        raise ConfigError(f"Could not load rules config {path}: {e}") from e
    _need(isinstance(got, dict), f"Rules config must contain a JSON object: {path}")
    return got


def vocabulary(config: dict) -> Vocabulary:
    """The built-in vocabulary extended by a rules configuration."""
    base = Vocabulary()

    def classes(key: str, have: dict[str, str], exact: bool = False) -> dict[str, str]:
        once = _Once(key, exact)
        for name in _texts(config.get(key, []), key):
            once.put(name, name.strip() if exact else suffix(name).strip())
        return have | dict(once)

    def methods(key: str, exact: bool) -> dict[str, str]:
        once = _Once(key, exact)
        for name, method in _object(config.get(key, {}), key).items():
            _need(isinstance(method, str) and bool(method.strip()), f"{key} must map rule class names to non-empty HTTP method strings")
            once.put(name, method.strip().upper())
        return dict(once)

    def attributes(key: str, exact: bool) -> dict[str, dict]:
        once = _Once(key, exact)
        for name, concepts in _object(config.get(key, {}), key).items():
            found = {}
            for concept, names in _object(concepts, f"{key}.{name}").items():
                _need(concept in ALIASES, f"Unknown {key} concept: {concept}")
                found[concept] = tuple(dict.fromkeys(_texts(names, f"{key}.{name}.{concept}", empty=False)))
            once.put(name, found)
        return dict(once)

    aliases = dict(base.aliases)
    for concept, names in _object(config.get("attribute_aliases", {}), "attribute_aliases").items():
        _need(concept in ALIASES, f"Unknown attribute alias concept: {concept}")
        aliases[concept] = tuple(dict.fromkeys((*ALIASES[concept], *_texts(names, f"attribute_aliases.{concept}"))))
    out = replace(
        base,
        api=classes("api_rule_classes", base.api), api_exact=classes("api_rule_classes_exact", {}, exact=True),
        component=classes("component_rule_classes", base.component), other=classes("non_api_rule_classes", base.other), aliases=aliases,
        methods=methods("method_by_rule_class_suffix", False), methods_exact=methods("method_by_rule_class", True),
        attributes=attributes("api_rule_attributes", False), attributes_exact=attributes("api_rule_attributes_exact", True),
        overrides=attributes("api_rule_attribute_overrides", False), overrides_exact=attributes("api_rule_attribute_overrides_exact", True),
    )
    both = out.api.keys() & (out.component.keys() | out.other.keys())
    _need(not both, f"Rule classes cannot be both API and non-API/component: {', '.join(sorted(both))}")
    return out


UNKNOWN_KIND = {"kind": "unknown", "attributes": {}, "defaults": {}, "origin": "unknown"}
_SPEC_KEYS = {"class", "kind", "attributes", "defaults", "branches", "branch_attribute", "override"}


class Semantics:
    """What each rule class does in a trace: kind, renamed attributes, defaults and branch labels."""

    def __init__(self, config: dict):
        self.rules = {c.casefold(): UNKNOWN_KIND | {"kind": k, "origin": "standard"} for c, k in KINDS.items()}
        for name, kind in _object(config.get("trace_rule_kinds", {}), "trace_rule_kinds").items():
            _need(bool(name) and kind in KINDS.values(), "trace_rule_kinds must map class names to supported trace kinds")
            key = suffix(name).casefold()
            _need(self.rules.get(key, {"kind": kind})["kind"] == kind, f"Use trace.rules with override=true to override {name}")
            self.rules[key] = UNKNOWN_KIND | {"kind": kind, "origin": "legacy_extension"}
        extension = _object(config.get("trace", {}), "trace")
        _need(not extension.keys() - {"schema_version", "rules"}, "trace supports only schema_version and rules")
        _need(extension.get("schema_version", 1) == 1, "Unsupported trace configuration schema_version")
        specs = extension.get("rules", [])
        _need(isinstance(specs, list), "trace.rules must be an array")
        said = {s["class"].casefold() for s in specs if isinstance(s, dict) and isinstance(s.get("class"), str)}
        seen: set[str] = set()
        for spec in specs:
            self._extend(spec, said, seen)
        self.branch_attributes = frozenset(r.get("branch_attribute", "RuleType") for r in self.rules.values())
        self.signature = hashlib.sha256(json.dumps(self.rules, sort_keys=True).encode()).hexdigest()

    def _extend(self, spec, said: set[str], seen: set[str]) -> None:
        _need(isinstance(spec, dict) and not spec.keys() - _SPEC_KEYS, "Invalid trace rule configuration keys")
        name, kind = spec.get("class"), spec.get("kind")
        _need(isinstance(name, str) and bool(name.strip()) and kind in KINDS.values(), "Each trace rule needs a class and supported kind")
        key = name.casefold()
        _need(key not in seen, f"Duplicate trace rule: {name}")
        seen.add(key)
        override = spec.get("override", False)
        _need(isinstance(override, bool), "override must be boolean")
        hides = key in self.rules or "." in key and suffix(key) in self.rules.keys() | said
        _need(override or not hides, f"Overriding {name} requires override=true")
        renamed, defaults = spec.get("attributes", {}), spec.get("defaults", {})
        for what, values in (("attributes", renamed), ("defaults", defaults)):
            ok = isinstance(values, dict) and not values.keys() - set(TRACE_ATTRIBUTES) and all(isinstance(v, str) for v in values.values())
            _need(ok, f"{name}.{what} needs supported canonical keys and string values")
        _need(all(renamed.values()) and len(set(renamed.values())) == len(renamed), f"{name}: attribute mappings must be nonempty and unambiguous")
        branches = spec.get("branches", BRANCHES)
        _need(isinstance(branches, dict) and bool(branches) and all(k and isinstance(v, bool) for k, v in branches.items()), f"{name}: branches must map labels to booleans")
        by = spec.get("branch_attribute", "RuleType")
        _need(isinstance(by, str) and bool(by), "branch_attribute must be a nonempty string")
        self.rules[key] = {"kind": kind, "attributes": renamed, "defaults": defaults, "branches": branches, "branch_attribute": by, "origin": "project_extension"}

    def of(self, rule_class: str) -> dict:
        return self.rules.get(rule_class.casefold()) or self.rules.get(suffix(rule_class).casefold()) or UNKNOWN_KIND

    @staticmethod
    def normal(raw: dict[str, str], spec: dict) -> dict[str, str]:
        """Attributes under canonical names. A renamed one comes from its own name only, even if that is absent."""
        out = {k: v for k, v in raw.items() if k not in spec["attributes"]}
        out |= {k: raw[own] for k, own in spec["attributes"].items() if own in raw}
        return spec["defaults"] | out
