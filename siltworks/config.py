"""Options and fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field

# What counts as text, image, video and audio, and what a scan ignores by default.
TEXT_EXTENSIONS = (
    ".txt", ".md", ".markdown", ".log", ".csv", ".json", ".xml", ".yaml", ".yml", ".js", ".ts", ".jsx", ".tsx", ".py", ".java",
    ".c", ".cpp", ".h", ".hpp", ".cs", ".go", ".rs", ".rb", ".php", ".swift", ".kt", ".scala", ".html", ".css", ".scss", ".less",
    ".sql", ".sh", ".bash", ".zsh", ".fish", ".bat", ".cmd", ".ini", ".conf", ".config", ".toml", ".env",
)
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp")
VIDEO_EXTENSIONS = (".mp4", ".mkv", ".avi", ".mov", ".webm")
AUDIO_EXTENSIONS = (".mp3", ".wav", ".flac", ".ogg", ".m4a")
DEFAULT_IGNORE = (
    "node_modules/**", ".git/**", "dist/**", "build/**", "target/**", "*.log", ".DS_Store", "Thumbs.db",
    "__pycache__/**", "*.pyc", "*.pyo", "*.class", "*.jar",
)
NAME_PATTERNS = ("original", "copy", "backup", "副本")

NO_EXTENSION = "(no extension)"
MAX_TEXT_BYTES = 10 * 1024 * 1024
TEXT_TOLERANCE = 0.2
MEDIA_TOLERANCE = 0.3
QUICK_BYTES = 4096

KEEP_RULES = ("mtime_newest", "mtime_oldest", "depth_shallowest", "path_shortest", "name_pattern", "prefer_dir")


@dataclass(frozen=True)
class ScanOptions:
    min_size: int | None = None
    max_size: int | None = None
    extensions: tuple[str, ...] = ()
    ignore_file: str | None = None
    gitignore: bool = True


@dataclass(frozen=True)
class NearOptions:
    threshold: float = 0.85
    text_extensions: tuple[str, ...] = TEXT_EXTENSIONS
    image_extensions: tuple[str, ...] = IMAGE_EXTENSIONS
    max_text_bytes: int = MAX_TEXT_BYTES


@dataclass(frozen=True)
class CleanupOptions:
    rule: str = "mtime_newest"
    prefer_dir: str | None = None
    name_patterns: tuple[str, ...] = NAME_PATTERNS
    dry_run: bool = True


@dataclass(frozen=True)
class RunOptions:
    scan: ScanOptions = field(default_factory=ScanOptions)
    near: NearOptions | None = None
    cleanup: CleanupOptions | None = None
    report: str = "json"
    output: str | None = None
    index: str | None = None
    rebuild_index: bool = False
