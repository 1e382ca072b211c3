"""Settings of the data path, and the compatibility rules of a run's settings as columns."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(slots=True)
class DataSettings:
    dataset: str = ""
    dataset_split: str = "train"
    streaming: bool = False
    max_seq_length: int = 8192
    messages_field: str = "messages"
    packing: bool = False
    length_group_buffer: int = 512
    seed: int = 42
    sources: list = field(default_factory=list)
    include_observations: bool = False
    train_on_reasoning: bool = True
    turn_scaling: str = "uniform"
    last_turn_only: bool = False
    replay_dataset: str = ""
    replay_weight: float = 0.1
    adaptive_sources: bool = False
    curriculum: bool = False
    pretokenize: bool = False


@dataclass(slots=True)
class SelectionSettings:
    enabled: bool = False
    format: str = "parquet"
    max_samples: int = 0
    budget: int = 0
    eval_holdout: int = 0
    min_ppl: float = 1.5
    max_ppl: float = 500.0
    filter_score: str = "response"
    strategy: str = "optimal"
    hes_top_k_pct: float = 0.5


@dataclass(slots=True)
class Settings:
    data: DataSettings = field(default_factory=DataSettings)
    preprocess: SelectionSettings = field(default_factory=SelectionSettings)

    @classmethod
    def of(cls, values: dict, overrides: list[str] = ()) -> Settings:
        """From nested values and section.field=text overrides; texts take the field's type, unknown names are ignored."""
        out = cls()
        pairs = [(s, k, v) for s, part in values.items() if isinstance(part, dict) for k, v in part.items()]
        pairs += [(*o.lstrip("-").split("=", 1)[0].split(".", 1), o.split("=", 1)[1]) for o in overrides if "=" in o and "." in o.split("=", 1)[0]]
        for section, name, value in pairs:
            part = getattr(out, section, None)
            if part is not None and name in {f.name for f in fields(part)}:
                setattr(part, name, _typed(value, getattr(part, name)))
        return out

    @classmethod
    def read(cls, args: list[str]) -> Settings:
        """From a command line: a YAML or JSON file, first or after --config, and --section.field=value or
        --section.field value after it, which win over the file."""
        args = list(args)
        path = args.pop(0) if args and not args[0].startswith("--") else None
        overrides: list[str] = []
        while args:
            word = args.pop(0)
            if word == "--config" or word.startswith("--config="):
                path = word.split("=", 1)[1] if "=" in word else args.pop(0)
            elif word.startswith("--") and "=" not in word:
                overrides.append(f"{word}={args.pop(0) if args and not args[0].startswith('--') else 'true'}")
            else:
                overrides.append(word)
        return cls.of(read_yaml(path) if path else {}, overrides)

    def flat(self) -> dict[str, object]:
        return {f"{s.name}/{f.name}": getattr(getattr(self, s.name), f.name) for s in fields(self) for f in fields(getattr(self, s.name))}


def read_yaml(path: str) -> dict | list:
    """A YAML (or JSON) file of the driver; an empty one has no settings."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ModuleNotFoundError:
        import json

        return json.loads(text or "{}")
    return yaml.safe_load(text) or {}


def read_sources(path: str) -> list[dict]:
    """The sources of a file: a list, or what stands under `sources`."""
    found = read_yaml(path)
    return list(found if isinstance(found, list) else found.get("sources", []))


def ablation_grid(base: dict, variants: dict[str, dict[str, object]]) -> dict[str, Settings]:
    """Settings by variant name: the base with that variant's {section.field: value}."""
    return {name: Settings.of(base, [f"{k}={v}" for k, v in changes.items()]) for name, changes in variants.items()}


def _typed(value: object, like: object) -> object:
    if not isinstance(value, str) or isinstance(like, str):
        return value
    if isinstance(like, bool):
        return value.strip().lower() in ("1", "true", "yes", "on")
    return type(like)(value) if isinstance(like, int | float) else value


#: name of the rule -> condition over the flags of a run. Errors stop a run, warnings do not.
ERRORS = {
    "release_needs_one_accumulation": "gradient_release AND accumulation > 1",
    "release_or_ramp": "gradient_release AND ga_ramp_start > 0",
    "release_or_muon": "gradient_release AND optimizer = 'muon'",
    "packing_or_context_parallel": "packing AND context_parallel",
    "mona_or_schedule_free": "mona AND schedule_free",
    "hyperball_or_schedule_free": "hyperball AND schedule_free",
    "one_token_loss": "cast(dft AS int) + cast(cadft AS int) + cast(deft AS int) + cast(info_sft AS int) > 1",
    "prepared_or_sources": "preprocess_enabled AND n_sources > 0",
    "cache_or_adaptive_sources": "pretokenize AND adaptive_sources",
    "cache_or_curriculum": "pretokenize AND curriculum",
}
WARNINGS = {
    "release_without_clipping": "gradient_release AND max_grad_norm > 0 AND NOT adagc",
    "release_with_hyperball": "gradient_release AND hyperball",
    "release_with_mona": "gradient_release AND mona",
    "ema_with_merge": "ema AND base_merge",
    "clipping_twice": "adagc AND spike_detection",
    "ramp_with_mona": "ga_ramp_start > 0 AND mona",
    "curriculum_with_packing": "curriculum AND packing",
    "pre_rl_shadowed": "pre_rl AND (deft OR cadft OR dft OR info_sft OR chunked_loss)",
}
SANITY = {
    "lr_high": "learning_rate > 1e-3",
    "lr_low": "learning_rate < 1e-7",
    "batch_small": "batch * accumulation < 4",
    "batch_large": "batch * accumulation > 512",
    "long_without_context_parallel": "max_seq_length > 32768 AND NOT context_parallel",
    "long_without_chunked_loss": "max_seq_length > 4096 AND NOT chunked_loss",
    "long_without_checkpointing": "gradient_checkpointing = 'none' AND max_seq_length > 2048",
    "no_warmup": "warmup_ratio = 0",
}


def broken(rules: dict[str, str]) -> Column:
    """Names of the rules whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in rules.items()]))


def check(runs: DataFrame) -> DataFrame:
    """runs (one row per setting) with errors, warnings and sanity as arrays of rule names."""
    return runs.withColumns({"errors": broken(ERRORS), "warnings": broken(WARNINGS), "sanity": broken(SANITY)})
