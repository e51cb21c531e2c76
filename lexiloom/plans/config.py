"""Run configuration: nested keys, per-pair and per-language blocks with defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

from lexiloom.sources.corpus import flat_config

STEPS = ("clean", "subword", "merge", "ras")


@dataclass
class PairConfig:
    deduplicate: bool = True
    shuffle: bool = False
    keep_lines_percent: float = 100.0


@dataclass
class LanguageConfig:
    do_normalize_punctuations: bool = True
    tokenizer: str = "Moses"


@dataclass
class SubstitutionConfig:
    replace_prob: float = 0.15
    num_repeat: int = 1
    vocab_size: int = 2000
    max_dep: int = 1
    languages: list[str] = field(default_factory=list)
    target_languages: list[str] = field(default_factory=list)
    dict_path: str = ""
    multi_dict_path: str = ""


def _typed(kind: type, values: dict):
    """A dataclass from a dictionary of texts or plain values; unknown keys are ignored."""
    out = {}
    for name, f in kind.__dataclass_fields__.items():
        if name not in values:
            continue
        v, default = values[name], f.default
        if isinstance(default, bool):
            v = str(v).lower() == "true"
        elif isinstance(default, (int, float)):
            v = type(default)(v)
        elif isinstance(v, str) and f.default_factory is list:
            v = [x for x in v.split(";") if x]
        out[name] = v
    return kind(**out)


@dataclass
class RunConfig:
    tree: dict

    @property
    def flat(self) -> dict[str, str]:
        return flat_config(self.tree)

    @property
    def steps(self) -> list[str]:
        asked = str(self.tree.get("preprocess_steps_list", ":".join(STEPS)))
        return [s for s in STEPS if s in asked]

    def names(self, key: str) -> list[str]:
        return [x for x in str(self.tree.get(key, "")).split(";") if x]

    @property
    def ratios(self) -> dict[str, float]:
        """Resampling ratios of directions such as en2de."""
        return {k: float(v) for k, v in self.tree.get("resample", {}).items()}

    def pair(self, name: str) -> PairConfig:
        """The block of a pair, of its reversed name, or the default one."""
        a, _, b = name.partition("_")
        for key in (name, f"{b}_{a}", "default_pairs"):
            if key in self.tree:
                return _typed(PairConfig, self.tree[key])
        return PairConfig()

    def language(self, name: str) -> LanguageConfig:
        return _typed(LanguageConfig, self.tree.get(name, self.tree.get("default_langs", {})))

    @property
    def substitution(self) -> SubstitutionConfig:
        return _typed(SubstitutionConfig, self.tree.get("ras", {}))

    def resolved(self, key: str) -> dict:
        """What one pair or language runs with: its own keys over the shared ones."""
        own = self.pair(key) if "_" in key else self.language(key)
        return {"name": key, "steps": self.steps} | own.__dict__


    def generated(self) -> dict[str, str]:
        """The configuration text of each pair and language, as ``parse`` reads it: its own settings and the shared ones."""
        out = {}
        for key in [*self.names("pairs"), *self.names("languages")]:
            own = self.resolved(key)
            lines = [f"{k}: {':'.join(v) if isinstance(v, list) else str(v).lower() if isinstance(v, bool) else v}" for k, v in own.items()]
            out[key] = "\n".join(lines) + "\n"
        return out


def parse(text: str) -> RunConfig:
    """Configuration text with two-space indents and ``key: value`` lines, comments after #."""
    tree: dict = {}
    stack = [tree]
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth = (len(line) - len(line.lstrip())) // 2
        key, _, value = line.strip().partition(":")
        del stack[depth + 1 :]
        value = value.strip().strip("\"'")
        if value:
            stack[depth][key] = value
        else:
            stack[depth][key] = {}
            stack.append(stack[depth][key])
    return RunConfig(tree)
