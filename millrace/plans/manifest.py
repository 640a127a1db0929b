"""The search manifest: a YAML document, validated as a whole, and its compilation to columns."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from enum import StrEnum
from pathlib import Path
from typing import Any, Literal, Self

import yaml
from pydantic import BaseModel, ConfigDict, Field, ValidationError, model_validator
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.errors import ManifestError
from millrace.functions import jsonout, text


class Strict(BaseModel):
    """Unknown keys are errors at every level; values don't change."""

    model_config = ConfigDict(extra="forbid", frozen=True, populate_by_name=True)


class PrefilterMode(StrEnum):
    ANY = "any"
    ALL = "all"
    NONE = "none"
    OFF = "off"


class Chunking(Strict):
    size: int = Field(80, ge=1)
    overlap: int = Field(10, ge=0)

    @model_validator(mode="after")
    def _window(self) -> Self:
        text.check_window(self.size, self.overlap)
        return self


class Prefilter(Strict):
    mode: PrefilterMode = PrefilterMode.OFF
    patterns: tuple[str, ...] = ()
    case_sensitive: bool = False
    regex: bool = False

    @model_validator(mode="after")
    def _patterns(self) -> Self:
        if self.enabled and not self.patterns:
            raise ValueError("an active prefilter needs at least one pattern")
        return self

    @property
    def enabled(self) -> bool:
        return self.mode is not PrefilterMode.OFF

    def keeps(self, column: Column) -> Column:
        return text.prefilter(column, self.mode.value, self.patterns, self.case_sensitive, self.regex)


class Years(Strict):
    min: int | None = None
    max: int | None = None

    @model_validator(mode="after")
    def _order(self) -> Self:
        if self.min is not None and self.max is not None and self.min > self.max:
            raise ValueError("the first year lies after the last")
        return self


class Select(Strict):
    languages: tuple[str, ...] = ("en",)
    title_types: tuple[str, ...] = ()
    years: Years = Years()
    exclude_adult: bool = True
    imdb_ids: tuple[str, ...] | None = None

    @property
    def needs_title(self) -> bool:
        """Whether a file without a title falls out of the selection."""
        return bool(self.title_types or self.exclude_adult or self.years.min is not None or self.years.max is not None)

    def of_files(self) -> Column:
        """The predicate on files; it reaches the scan before any join."""
        c = F.col("language").isin(*self.languages)
        return c if self.imdb_ids is None else c & F.col("imdb_id").isin(*self.imdb_ids)

    def of_titles(self) -> Column:
        c = F.lit(True)
        if self.title_types:
            c &= F.col("title_type").isin(*self.title_types)
        if self.years.min is not None:
            c &= F.col("start_year") >= self.years.min
        if self.years.max is not None:
            c &= F.col("start_year") <= self.years.max
        return c & ~F.col("is_adult") if self.exclude_adult else c


class Prompt(Strict):
    user: str = Field(min_length=1)
    system: str | None = None


class Output(Strict):
    format: Literal["json", "text"] = "json"
    json_schema: dict[str, Any] | None = Field(None, alias="schema")

    @model_validator(mode="after")
    def _schema(self) -> Self:
        if self.json_schema is not None:
            if self.format == "text":
                raise ValueError("a text answer can't have a schema")
            try:
                jsonout.check_schema(self.json_schema)
            except ManifestError as e:
                raise ValueError(str(e)) from e
        return self


class Manifest(Strict):
    name: str = Field(min_length=1)
    description: str | None = None
    model: str = Field(min_length=1)
    options: dict[str, Any] = Field(default_factory=dict)
    select: Select = Select()
    chunk: Chunking = Chunking()
    prefilter: Prefilter = Prefilter()
    prompt: Prompt
    output: Output = Output()
    match_when: str | None = None

    @model_validator(mode="after")
    def _match(self) -> Self:
        if self.match_when is not None and self.output.format == "text":
            raise ValueError("match_when needs a JSON answer")
        return self


@dataclass(frozen=True)
class Loaded:
    manifest: Manifest
    source: str
    hash: str
    path: str


def source_hash(source: str) -> str:
    """SHA-256 of the source; kinds of line ends are the one difference that doesn't count."""
    return hashlib.sha256(source.replace("\r\n", "\n").replace("\r", "\n").encode()).hexdigest()


def parse(source: str, path: str = "<text>") -> Loaded:
    try:
        data = yaml.safe_load(source)
    except yaml.YAMLError as e:
        raise ManifestError(f"{path}: not YAML: {e}") from e
    if not isinstance(data, dict):
        raise ManifestError(f"{path}: a manifest is a mapping")
    try:
        manifest = Manifest.model_validate(data)
    except ValidationError as e:
        first = e.errors()[0]
        raise ManifestError(f"{path}: {'.'.join(map(str, first['loc']))}: {first['msg']}") from e
    return Loaded(manifest, source, source_hash(source), path)


def load(path: str | Path) -> Loaded:
    try:
        source = Path(path).read_bytes().decode("utf-8")
    except (OSError, UnicodeDecodeError) as e:
        raise ManifestError(f"{path}: can't be read: {e}") from e
    return parse(source, str(path))
