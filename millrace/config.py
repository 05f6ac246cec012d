"""Default parameters and fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field

try:
    import yaml
except ImportError:
    yaml = None

MB = 1024**2


@dataclass(frozen=True)
class RepoConfig:
    buckets: tuple[str, ...] = ("0.5-1:10", "1-5:50", "5-15:50")
    candidates_per_bucket: int = 500
    scan_max: int = 300_000
    random_top_k: int = 8
    max_repos_per_owner: int = 1
    max_file_kb: int = 2048
    max_actual_kb: int = 4096
    max_line_length: int = 2000
    min_alphanum: float = 0.25
    target_total_mb: int = 100
    overshoot_bytes: int = 5 * MB
    min_core_ratio: float = 0.55
    min_core_files: int = 25
    max_single_mb: float = 15.0
    score_threshold: float = 60.0
    post_min_py_mb: float = 0.1
    post_min_py_ratio: float = 0.55


@dataclass(frozen=True)
class SampleConfig:
    max_seq_len: int = 2048
    reserve: int = 8
    min_content_tokens: int = 128
    min_chars: int = 50
    max_chars: int = 1_000_000
    samples_per_repo: int = 1000
    cross_samples_per_repo: int = 100
    cross_budget: int = 512
    cross_top_files: int = 5
    cross_lines: int = 25
    ngram: int = 10


@dataclass(frozen=True)
class FimConfig:
    skip_length: int = 10
    min_length: int = 5
    sfim_rate: float = 0.5
    fim_rate: float = 0.3
    max_length: int = 2048
    batch_size: int = 4
    label_ignore: int = -100
    file_mark: str = "<|file_sep|>"
    repo_mark: str = "<|repo_name|>"
    eot_mark: str = "<|endoftext|>"
    pad_id: int = 0


@dataclass(frozen=True)
class EvalConfig:
    rounds: int = 5
    users: int = 16
    max_tokens: int = 128
    span: tuple[int, int] = (16, 128)
    span_margin: tuple[int, int] = (32, 160)
    timeout_s: float = 3.0
    downloads_at_once: int = 64
    programs_at_once: int = 24
    cceval_max_tokens: int = 2048
    performance_tokens: tuple[int, int] = (2048, 4096)


@dataclass(frozen=True)
class Sentinels:
    pre: str
    mid: str
    suf: str


# The models' own special tokens; DeepSeek's middle and suffix marks are swapped on purpose.
SENTINELS = {
    "qwen": Sentinels("<|fim_prefix|>", "<|fim_middle|>", "<|fim_suffix|>"),
    "deepseek": Sentinels("<｜fim▁begin｜>", "<｜fim▁end｜>", "<｜fim▁hole｜>"),
    "llama": Sentinels("<fim_prefix>", "<fim_middle>", "<fim_suffix>"),
}

# Name lists that decide which files and repositories count.
CONFIG_MARKERS = ["pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "pipfile", "pipfile.lock", "environment.yml", "tox.ini", "poetry.lock", "makefile", "manage.py"]
JUNK_TOKENS = ["sample", "demo", "example", "exercise", "assignment", "homework", "tutorial", "playground", "practice", "course", "learn", "study", "tmp", "temp", "backup", "archive", "leetc", "katas"]
NONCORE_DIRS = [".github", ".gitlab", ".circleci", "docs", "doc", "examples", "example", "scripts", "script", "notebooks", "notebook", "bench", "benchmark", "assets", "data", "tests", "test", "testing", "venv", "env", "node_modules"]
GENERATED_SUBSTR = ["/migrations/", "/alembic/versions/", "/__pycache__/", "/build/", "/dist/", "/generated/", "/gen/", "/openapi/", "/swagger_client/"]
GENERATED_SUFFIX = ["_pb2.py", "_pb2_grpc.py", "_grpc.py", "_generated.py", "_gen.py", "ui_mainwindow.py", "_ui.py", "resources_rc.py"]
BINARY_EXTS = [
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".bmp", ".tiff", ".mp4", ".mov", ".mkv", ".avi", ".mp3", ".wav", ".flac",
    ".zip", ".tar", ".tgz", ".gz", ".rar", ".7z", ".bz2", ".xz", ".jar", ".war",
    ".pyc", ".pyo", ".o", ".obj", ".dll", ".so", ".dylib", ".exe", ".bin", ".class",
    ".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".db", ".sqlite", ".parquet", ".arrow", ".ds_store", ".ipynb",
]
START_MARKS = ["def ", "async def ", "function ", "async function "]
END_MARKS = ["@", "class ", "def ", "async def ", "function ", "async function "]


@dataclass(frozen=True)
class Config:
    """All settings of a run; built from a mapping such as a parsed YAML file with :meth:`from_mapping`."""

    repo: RepoConfig = field(default_factory=RepoConfig)
    sample: SampleConfig = field(default_factory=SampleConfig)
    fim: FimConfig = field(default_factory=FimConfig)
    eval: EvalConfig = field(default_factory=EvalConfig)

    @classmethod
    def from_mapping(cls, values: dict) -> Config:
        parts = {"repo": RepoConfig, "sample": SampleConfig, "fim": FimConfig, "eval": EvalConfig}
        if unknown := set(values) - set(parts):
            raise ValueError(f"unknown sections: {sorted(unknown)}")
        return cls(**{name: parts[name](**section) for name, section in values.items()})

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        """The settings of a YAML file on the driver; an empty file gives the defaults."""
        if yaml is None:
            raise ImportError("reading YAML needs the package yaml")
        with open(path, encoding="utf-8") as f:
            return cls.from_mapping(yaml.safe_load(f) or {})
