"""Settings of a job: defaults, a JSON file over them, and what the caller says over both."""

from __future__ import annotations

import json
import os
import warnings
from dataclasses import dataclass, field, fields, replace

from cuewright.functions.lexicon import LANGUAGES

NUMBER_MODES = ("auto", "src_lang", "digits", "tgt_lang")


@dataclass(frozen=True)
class Settings:
    """What a translation job can be told; names are those of the JSON file."""

    source_lang: str = "English"
    target_lang: str = "Chinese"
    target_lang_code: str = "CN"
    add_punctuation: bool = False
    allow_flexible_word_order: bool = False
    allow_simplify_wording: bool = False
    number_mode: str = "auto"
    space_between_cjk_and_latin: bool | str = "auto"
    glossary: list[str] = field(default_factory=list)
    custom_system_prompt: str | None = None
    cache_prompt: bool = False
    drift_threshold: float | bool | None = False

    def __post_init__(self):
        if self.number_mode not in NUMBER_MODES:
            raise ValueError(f"number_mode must be one of {', '.join(NUMBER_MODES)}")

    @property
    def spacing(self) -> str:
        """As the post-processing takes it: auto, true or false."""
        return str(self.space_between_cjk_and_latin).lower()

    @property
    def drift(self) -> float | None:
        """The threshold of drift, None where it is off (false, null); 0.16 for true."""
        d = self.drift_threshold
        return 0.16 if d is True else float(d) if d not in (None, False) else None


def load(path: str | None) -> dict:
    """The settings a JSON file names; {} without a file, and, with a warning, where it cannot be read as JSON.

    Keys that begin with an underscore are comments; unknown keys are kept for who asks for them (services, keys).
    """
    if not path or not os.path.exists(path):
        return {}
    try:
        with open(path, encoding="utf-8-sig") as f:
            found = json.load(f)
        if not isinstance(found, dict):
            raise ValueError("not an object")
    except ValueError as e:
        warnings.warn(f"{path} is no settings file: {e}; defaults are taken", stacklevel=2)
        return {}
    return {k: v for k, v in found.items() if not k.startswith("_")}


def settings(path: str | None = None, **said) -> Settings:
    """Defaults, the file over them, what is said (and not None) over both; language and code completed by each other."""
    known = {f.name for f in fields(Settings)}
    file = {k: v for k, v in load(path).items() if k in known}
    told = {k: v for k, v in said.items() if v is not None}
    if unknown := told.keys() - known:
        raise TypeError(f"no such setting: {', '.join(sorted(unknown))}")
    out = replace(Settings(), **{**file, **told})
    name, code = languages(out, told.get("target_lang"), told.get("target_lang_code"))
    return replace(out, target_lang=name, target_lang_code=code)


def languages(base: Settings, name: str | None, code: str | None) -> tuple[str, str]:
    """Target language and code: what is given completes the other; both given must belong together; unknown ones are taken as they are."""
    of = {c: n for n, c in LANGUAGES.items()}
    mapped_code = LANGUAGES.get(name.strip().lower()) if name else None
    mapped_name = of.get(code.strip().upper()) if code else None
    if name and code:
        if (mapped_code and mapped_code != code.strip().upper()) or (mapped_name and mapped_name != name.strip().lower()):
            raise ValueError(f"{name} and {code} are not the same language")
        return name, code
    if name:
        return name, mapped_code or base.target_lang_code
    if code:
        return mapped_name or base.target_lang, code
    return base.target_lang, base.target_lang_code


def service(path: str | None, name: str, env_file: str | None = None, **said) -> dict:
    """Address, model, key and form of a named service: said, else from `services` of the JSON file, else the key from the environment.

    An environment file (NAME=value lines) sets only variables that are not set. The key's variable is <NAME>_API_KEY,
    the address' API_BASE_URL. The form follows from the address unless it is given: one that ends in /messages speaks the
    messages form, any other the chat form.
    """
    if env_file and os.path.exists(env_file):
        with open(env_file, encoding="utf-8") as f:
            for line in f:
                k, eq, v = line.strip().partition("=")
                if eq and k.strip() and not k.startswith("#"):
                    os.environ.setdefault(k.strip(), v.strip().strip("\"'"))
    file = load(path)
    found = dict(file.get("services", {}).get(name, {}))
    found.setdefault("key", file.get(f"{name}_api_key", ""))
    found.setdefault("url", file.get("api_base_url", ""))
    found |= {k: v for k, v in said.items() if v not in (None, "")}
    found["key"] = found["key"] or os.environ.get(f"{name.upper()}_API_KEY", "")
    found["url"] = found["url"] or os.environ.get("API_BASE_URL", "")
    found.setdefault("model", "")
    found.setdefault("form", "messages" if found["url"].rstrip("/").endswith("/messages") else "chat")
    return found


def boolean(text: str | bool) -> bool:
    """True or false as a command line has it."""
    if isinstance(text, bool):
        return text
    word = text.strip().lower()
    if word in ("true", "1", "yes", "y", "t"):
        return True
    if word in ("false", "0", "no", "n", "f"):
        return False
    raise ValueError(f"true or false expected, not {text!r}")
