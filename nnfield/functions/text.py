"""Assembly of SQL text. A whole search round is one statement, so it is analysed once."""

from __future__ import annotations


def subquery(items: list[str], source: str, where: str | None = None, group_by: list[str] | None = None) -> str:
    text = f"(select {', '.join(items)} from {source}"
    if where:
        text += f" where {where}"
    if group_by:
        text += f" group by {', '.join(group_by)}"
    return text + ")"
