"""The prompts an operator may replace: their names, the values each must hold, and short packaged texts."""

from __future__ import annotations

#: Names of prompts and the values a replacement has to use.
SPECS: dict[str, tuple[str, ...]] = {
    "agent.system": ("catalog",),
    "agent.catalog_delimiter": ("catalog",),
    "agent.merged_load_note": (),
    "agent.grounding_nudge": (),
    "agent.grounding_figures": ("figures",),
    "agent.batch_reminder": ("calls",),
    "tool.get_catalog": (),
    "tool.check_and_load_kb": (),
    "memory.redundant_note": ("requested",),
    "voice.system": ("catalog",),
    "preprocess.folder_metadata": ("sections",),
    "evalgen.answer_rules": (),
    "evalgen.persona_framing": ("persona_name", "persona_description"),
    "evalgen.simple": ("content", "answer_rules", "persona_framing"),
    "evalgen.medium": ("packet_id", "paragraph", "answer_rules", "persona_framing"),
    "evalgen.complex": ("packet_id", "paragraphs", "answer_rules", "persona_framing"),
    "evalgen.hard1": ("packet_a_id", "packet_b_id", "paragraphs_a", "paragraphs_b", "answer_rules", "persona_framing"),
    "evalgen.hard2": ("packet_id", "content", "answer_rules", "persona_framing"),
    "eval.classify": ("question", "reply"),
    "eval.clarify": ("question", "expected_answer", "transcript", "last_reply"),
    "eval.score": ("question", "expected_answer", "actual_answer", "transcript"),
}

#: What each prompt asks for, in a line; the values follow under their names.
_TASKS = {
    "agent.system": "Answer from the packets you load. Choose them by the catalog below.",
    "agent.catalog_delimiter": "=== CATALOG ===",
    "agent.merged_load_note": "Your load calls were taken as one.",
    "agent.grounding_nudge": "Load the packet that holds the answer before you give it.",
    "agent.grounding_figures": "These figures stand in nothing you have loaded.",
    "agent.batch_reminder": "Name all packets of a turn in one call.",
    "tool.get_catalog": "The whole catalog, which the system prompt holds already.",
    "tool.check_and_load_kb": "Load packets by their ids and say which are active.",
    "memory.redundant_note": "All packets asked for are loaded already.",
    "voice.system": "Answer aloud and briefly, from the packets you load.",
    "preprocess.folder_metadata": 'Describe this folder. Reply with JSON: {"title": "", "long_description": ""}.',
    "evalgen.answer_rules": "Answer in full, with nothing that the text does not say.",
    "evalgen.persona_framing": "Ask as this person would.",
    "evalgen.simple": 'Ask one question that this text answers. Reply with JSON: {"question": "", "expected_answer": ""}.',
    "evalgen.medium": 'Ask one question that this paragraph answers. Reply with JSON: {"question": "", "expected_answer": ""}.',
    "evalgen.complex": 'Ask one question that needs all these paragraphs. Reply with JSON: {"question": "", "expected_answer": "", "cited_paragraph_indices": []}.',
    "evalgen.hard1": 'Ask one question that needs both packets. Reply with JSON: {"question": "", "expected_answer": "", "cited_packet_ids": []}.',
    "evalgen.hard2": 'Ask one question that needs the picture. Reply with JSON: {"question": "", "expected_answer": "", "image_reference": ""}.',
    "eval.classify": 'Does the reply answer, ask back or refuse? Reply with JSON: {"category": "answer"}, "clarify" or "refusal".',
    "eval.clarify": "You asked the question. Answer what the last reply asks back, without giving the expected answer away.",
    "eval.score": 'How well does the actual answer match the expected one, from 0 to 3? Reply with JSON: {"score": 0, "remark": ""}.',
}


def packaged() -> dict[str, str]:
    """The packaged text of every prompt, as a template."""
    return {name: "\n\n".join([_TASKS[name], *[f"{value}:\n${value}" for value in values]]) for name, values in SPECS.items()}


def file_names() -> dict[str, str]:
    """The file that replaces each prompt; two prompts under one name are an error."""
    import re

    out: dict[str, str] = {}
    for name in SPECS:
        key = re.sub(r"[^a-z0-9_-]", "", name.lower().replace(".", "-")) + ".md"
        if key in out.values():
            raise ValueError(f"two prompts would be read from {key}")
        out[name] = key
    return out


def check(texts: dict[str, str]) -> None:
    """Replacements must be named, not empty, and use every value of their prompt; all faults in one error."""
    wrong = [f"no prompt {name!r}" for name in texts if name not in SPECS]
    for name, text in texts.items():
        if name in SPECS:
            wrong += [f"{name} is empty"] if not text.strip() else [f"{name} does not use ${v}" for v in SPECS[name] if f"${v}" not in text and f"${{{v}}}" not in text]
    if wrong:
        raise ValueError("; ".join(wrong))
