"""What some frequent rules declare in attributes, without taking it for their behaviour.

Each class has a row of a table that says which attributes are shown, chosen between, read and written; one interpreter
fills the evidence from a rule's attributes.
"""

from __future__ import annotations

from dataclasses import dataclass

from lodeline.functions.references import field_references


@dataclass(frozen=True)
class Declares:
    """A class's row. Keys are the evidence's names, values attributes.

    constants: told of every rule. shown: attributes as they are. present: a list of attributes under one name, those that
    there are. names: comma lists. choice: (attribute, label -> attribute that holds the name). operands: (mode, path of a
    data item, text with references). reads: attributes that hold a path. writes: attributes that hold an output's path.
    """

    constants: tuple[tuple[str, object], ...] = ()
    shown: tuple[tuple[str, str], ...] = ()
    present: tuple[tuple[str, tuple[str, ...]], ...] = ()
    names: tuple[tuple[str, str], ...] = ()
    choice: tuple[tuple[str, str, dict[str, str]], ...] = ()
    operands: tuple[tuple[str, str, str, str], ...] = ()
    reads: tuple[str, ...] = ()
    writes: tuple[tuple[str, tuple[str, ...]], ...] = ()


# Classes, their attributes and the names under which evidence is told.
TABLE = {
    "AddToListRule": Declares(
        constants=(("list_target_is_datastore_write", False),),
        choice=(("list_target", "ListType", {"static": "StaticListToAddTo", "dynamic": "DynamicListToAddTo"}),),
        operands=(("key_source", "KeyType", "KeyPropertyName", "KeyValue"), ("value_source", "ValueType", "ValuePropertyName", "Value"), ("group_source", "GroupValueType", "GroupValuePropertyName", "GroupValue")),
        writes=(("error_outputs", ("ErrorCodeDataItem", "ErrorMsgDataItem")),),
    ),
    "CompareMultiListValuesRule": Declares(
        constants=(("new_list_values_role", "ambiguous"), ("new_list_values_write_proven", False)),
        shown=(("current_list_value", "CurrentListValue"), ("new_list_values", "NewListValues"), ("compare_values", "CompareValues"), ("value_separator", "ValueSeparator"), ("process_empty", "ProcessEmpty")),
        reads=("CurrentListValue",),
    ),
    "SetQuestionStatus": Declares(
        constants=(("read_only_effect_proven", False), ("mandatory_effect_proven", False)),
        shown=(("question_raw", "Question"),),
        names=(("ui_targets", "Question"),),
        present=(("status_flags", ("ReadOnly", "Mandatory", "ChangeMandatoryStatus", "ChangeReadOnlyStatus", "UndoRequired", "IgnoreQuestions", "IgnoreMandatoryQuestions", "RuleType", "RuleDisabled")),),
    ),
}


def declared(cls: str, bag: dict[str, str]) -> dict | None:
    """reads, writes and evidence of a rule of one of the table's classes."""
    row = TABLE.get(cls)
    if row is None:
        return None
    told = lambda attribute: (bag.get(attribute) or "").strip()
    evidence: dict = {"rule_class": cls, **dict(row.constants)}
    evidence |= {name: bag.get(attribute) for name, attribute in row.shown}
    evidence |= {name: {k: bag[k] for k in attributes if k in bag} for name, attributes in row.present}
    evidence |= {name: [x.strip() for x in told(attribute).split(",") if x.strip()] for name, attribute in row.names}
    for name, attribute, holders in row.choice:
        label = told(attribute).lower()
        known = label in holders
        evidence[name] = {"type": label if known else "unknown", "name": bag.get(holders[label]) if known else None}
    reads = [told(a) for a in row.reads]
    for name, mode, item, text in row.operands:
        modes = {
            "data item": lambda: told(item) and ({"mode": "Data Item", "path": told(item)}, [told(item)]),
            "value": lambda: ({"mode": "Value", "template": bag.get(text, ""), "template_dependencies": (f := field_references(bag.get(text, "")))}, f),
        }
        if found := modes.get(told(mode).casefold(), lambda: None)():
            evidence[name], more = found
            reads += more
    writes: list[str] = []
    for name, attributes in row.writes:
        if outputs := list(dict.fromkeys(told(a) for a in attributes if told(a))):
            evidence[name] = outputs
            writes += outputs
    return {"reads": list(dict.fromkeys(r for r in reads if r)), "writes": writes, "evidence": evidence}
