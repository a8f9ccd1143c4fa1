"""The project's config file and its skeleton."""

from __future__ import annotations

import logging
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from . import __version__
from .errors import IndexError_
from .functions.embedding import BACKENDS, HashBackend
from .parsers.registry import LANGUAGES, extensions, load_extra
from .plans.build import Tree

log = logging.getLogger(__name__)

PLACE = Path("docs") / ".helpers" / "config.toml"
TABLE = "index"
DEFAULT_MODELS = {"hash": HashBackend().name}


@dataclass
class Config:
    version: str
    project: str
    project_root: Path
    config_path: Path
    roots: list[str] = field(default_factory=lambda: ["."])
    ignores: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=lambda: list(LANGUAGES))
    extra_languages: list[str] = field(default_factory=list)
    embed_backend: str = "hash"
    embed_model: str = DEFAULT_MODELS["hash"]
    embed_batch_size: int = 16

    @property
    def index_path(self) -> Path:
        return self.config_path.parent / "index"

    def extra_paths(self) -> list[Path]:
        return [self.project_root / p for p in self.extra_languages]

    def active(self) -> dict[str, str]:
        """Extension to language of the languages in use; extra ones come last."""
        found = list(LANGUAGES.values()) + [x for p in self.extra_paths() for x in load_extra(p)]
        extra = {x.name for x in found[len(LANGUAGES) :]}
        return extensions([x for x in found if x.name in self.languages or x.name in extra and self.languages == list(LANGUAGES)])

    def tree(self, root: Path | None = None) -> Tree:
        return Tree(root or self.project_root, self.project, self.ignores, self.roots if root is None else (".",), self.active(), [str(p) for p in self.extra_paths()], self.embed_batch_size)

    def as_dict(self) -> dict:
        return {k: str(v) if isinstance(v, Path) else v for k, v in vars(self).items()}


def find_config(start: Path) -> Path:
    """The nearest config in ``start`` or a folder above it."""
    for folder in [start.resolve(), *start.resolve().parents]:
        if (folder / PLACE).is_file():
            return folder / PLACE
    raise IndexError_("index.missing", f"no {PLACE.as_posix()} in {start} or above it")


def _texts(table: dict, key: str, default: list[str]) -> list[str]:
    value = table.get(key, default)
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise IndexError_("config.parse_error", f"'{key}' must be a list of strings", key=key, value=value)
    return list(value)


def _checked_version(pin: object) -> str:
    from packaging.specifiers import InvalidSpecifier, SpecifierSet
    from packaging.version import Version

    if not isinstance(pin, str) or not pin:
        raise IndexError_("config.missing_key", "'version' must be a non-empty string", key="version", value=pin)
    try:
        allowed = SpecifierSet(pin)
    except InvalidSpecifier as e:
        raise IndexError_("config.version_mismatch", f"'{pin}' is no version specifier", pin=pin) from e
    if Version(__version__) not in allowed:
        raise IndexError_("config.version_mismatch", f"version {__version__} doesn't satisfy '{pin}'", pin=pin, engine_version=__version__)
    return pin


def load_config(path: Path, project_root: Path | None = None) -> Config:
    """Reads and checks a config; IndexError_ of a ``config.`` kind for the first fault. Unknown keys are warned of."""
    path = Path(path)
    root = project_root or path.resolve().parents[len(PLACE.parts) - 1]
    try:
        table = tomllib.loads(path.read_bytes().decode()).get(TABLE)
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        raise IndexError_("config.parse_error", f"{path} can't be read: {e}", path=str(path)) from e
    if not isinstance(table, dict):
        raise IndexError_("config.missing_key", f"{path} has no [{TABLE}]", path=str(path), key=TABLE)
    if "version" not in table:
        raise IndexError_("config.missing_key", f"{path} has no 'version'", path=str(path), key="version")
    for key in table.keys() - Config.__dataclass_fields__.keys():
        log.warning("%s: unknown key '%s'", path, key)
    backend = table.get("embed_backend", "hash")
    if backend not in BACKENDS:
        raise IndexError_("config.bad_enum", f"no such embed_backend: {backend!r}", key="embed_backend", value=backend, allowed=sorted(BACKENDS))
    model = table.get("embed_model", DEFAULT_MODELS.get(backend, backend))
    if not isinstance(model, str) or not model:
        raise IndexError_("config.model_backend_mismatch", "'embed_model' must be a non-empty string", key="embed_model", value=model, backend=backend)
    project = table.get("project", root.name)
    if not isinstance(project, str) or not project:
        raise IndexError_("config.parse_error", "'project' must be a non-empty string", key="project", value=project)
    lists = {k: _texts(table, k, d) for k, d in (("roots", ["."]), ("ignores", []), ("languages", list(LANGUAGES)), ("extra_languages", []))}
    batch = table.get("embed_batch_size", 16)
    if not isinstance(batch, int) or isinstance(batch, bool) or batch < 1:
        raise IndexError_("config.parse_error", "'embed_batch_size' must be a positive integer", key="embed_batch_size", value=batch)
    version = _checked_version(table["version"])
    for key, there in (("roots", Path.exists), ("extra_languages", Path.is_file)):
        for value in lists[key]:
            if not there((root / value).resolve()):
                raise IndexError_("config.bad_path", f"'{key}': there is no {value} under {root}", key=key, value=value)
    names = set(LANGUAGES) | {Path(p).stem for p in lists["extra_languages"]}
    names |= {x.name for p in lists["extra_languages"] for x in load_extra(root / p)}
    for value in lists["languages"]:
        if value not in names:
            raise IndexError_("config.unknown_language", f"no such language: {value}", key="languages", value=value, known=sorted(names))
    return Config(version, project, root, path, **lists, embed_backend=backend, embed_model=model, embed_batch_size=batch)


def version_pin(version: str = __version__) -> str:
    """From this minor version on, below the second next."""
    major, minor = (int(x) for x in version.split(".")[:2])
    return f">={major}.{minor},<{major}.{minor + 2}"


IGNORED = "index/\n"


def write_skeleton(root: Path, name: str | None = None, force: bool = False) -> dict:
    """A config and an ignore file for the index; an existing config stays unless ``force``."""
    path = Path(root).resolve() / PLACE
    there = path.exists()
    if there and not force:
        raise IndexError_("cli.not_implemented", f"{path.as_posix()} exists; --force overwrites it", path=path.as_posix())
    project = name or Path(root).resolve().name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(f'[{TABLE}]\nversion = "{version_pin()}"\nproject = "{project}"\nroots = ["."]\nembed_backend = "hash"\nembed_model = "{DEFAULT_MODELS["hash"]}"\n')
    ignore = path.parent / ".gitignore"
    if not ignore.exists() or ignore.read_text() != IGNORED:
        ignore.write_text(IGNORED)
    return {"config_path": str(path), "gitignore_path": str(ignore), "project": project, "force_used": bool(force and there)}
