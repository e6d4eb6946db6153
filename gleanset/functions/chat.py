"""Prompts and chat-shaped records as nested column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanset import fixed
from gleanset.functions import text as tx


@dataclass(frozen=True)
class ChatTemplate:
    """Turn markers of a chat rendering. The defaults (fixed values) mark turns by header tokens."""

    begin: str = "<|begin_of_text|>"
    before_role: str = "<|start_header_id|>"
    after_role: str = "<|end_header_id|>\n\n"
    end_turn: str = "<|eot_id|>"
    trim_content: bool = True


def _turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def require_fields(*fields: Column) -> Column:
    """True when no field is null; otherwise the query fails with a message."""
    present = fields[0].isNotNull()
    for field in fields[1:]:
        present = present & field.isNotNull()
    return F.assert_true(present, "a sample is missing instruction, input or output").isNull()


def to_messages(
    instruction: Column,
    text: Column,
    answer: Column | None = None,
    system: str | None = fixed.SYSTEM_PROMPT,
) -> Column:
    """Optional system turn, the user turn, and the assistant turn when an answer is given."""
    turns = [_turn("system", F.lit(system))] if system else []
    turns.append(_turn("user", F.concat(instruction, F.lit("\n\nText: "), text)))
    if answer is not None:
        turns.append(_turn("assistant", answer.cast("string")))
    return F.array(*turns)


def render_chat(
    messages: Column, template: ChatTemplate = ChatTemplate(), add_generation_prompt: bool = False
) -> Column:
    """One string per message list; optionally ends in an open assistant turn."""

    def turn(message: Column) -> Column:
        content = message["content"]
        return F.concat(
            F.lit(template.before_role),
            message["role"],
            F.lit(template.after_role),
            tx.strip(content) if template.trim_content else content,
            F.lit(template.end_turn),
        )

    opened = template.before_role + "assistant" + template.after_role if add_generation_prompt else ""
    return F.concat(F.lit(template.begin), F.array_join(F.transform(messages, turn), ""), F.lit(opened))


def label_prompt(text: Column, instruction: str = fixed.INSTRUCTION) -> Column:
    """The three-line prompt that asks for a label of a news text."""
    return F.concat(F.lit(f"Instruction: {instruction}\nNews: "), text, F.lit("\nSentiment:"))


def strip_prompt_echo(prompt: Column, text: Column) -> Column:
    """Cut the prompt's words after its last colon off the start of the text."""
    tail = tx.strip(F.substring_index(prompt, ":", -1))
    echoed = F.contains(prompt, F.lit(":")) & (tail != "") & F.startswith(text, tail)
    return F.when(echoed, tx.strip(F.substring(text, F.length(tail) + 1, F.length(text)))).otherwise(text)
