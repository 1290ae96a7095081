"""The word that marks directives: ``<word>:disable`` comments, ``data-<word>-`` attributes, rule names about them, and a template extension.

A project with templates of its own convention sets it through the environment
variable ``TESSERA_DIRECTIVES``, on the driver and on executors.
"""

from __future__ import annotations

import os

WORD = os.environ.get("TESSERA_DIRECTIVES", "tpl")


def named(text: str) -> str:
    """``text`` with the word in place of ``{word}``."""
    return text.replace("{word}", WORD)
