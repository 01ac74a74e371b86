"""The catalogue of modules: ports, parameters and defaults. What they do is in ``compiler``."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from brindle.ml.trainers import DEFAULTS, TASKS


@dataclass(frozen=True)
class Port:
    name: str
    kind: str  # Dataset, UntrainedModel, TrainedModel, Metrics
    required: bool = True


@dataclass(frozen=True)
class Parameter:
    name: str
    default: str | None = None
    required: bool = False
    choices: tuple[str, ...] = ()


@dataclass(frozen=True)
class Module:
    id: str
    name: str
    category: str
    inputs: tuple[Port, ...] = ()
    outputs: tuple[Port, ...] = ()
    parameters: tuple[Parameter, ...] = ()
    task: str | None = None
    extra: dict = field(default_factory=dict)


DATA, UNTRAINED, TRAINED, METRICS = "Dataset", "UntrainedModel", "TrainedModel", "Metrics"
_IN = (Port("Dataset", DATA),)
_OUT = (Port("Dataset", DATA),)


def _parameters(text: str) -> tuple[Parameter, ...]:
    """``name! other=default kind=a|b`` to parameters: ``!`` is required, ``|`` lists choices of which the first is the default."""
    out = []
    for word in text.split():
        name, _, default = word.partition("=")
        choices = tuple(default.split("|")) if "|" in default else ()
        out.append(Parameter(name.rstrip("!"), (choices[0] if choices else default) or None, name.endswith("!"), choices))
    return tuple(out)


def _module(id: str, name: str, category: str, inputs: tuple[Port, ...], outputs: tuple[Port, ...], parameters: str = "", task: str | None = None) -> Module:
    return Module(id, name, category, inputs, outputs, _parameters(parameters), task)


def _catalogue() -> list[Module]:
    two = (Port("Left", DATA), Port("Right", DATA))
    optional = (Port("Dataset 1", DATA, False), Port("Dataset 2", DATA, False))
    split = (Port("First part", DATA), Port("Second part", DATA))
    ranked = (Port("Dataset", DATA), Port("Feature scores", METRICS))
    asked = "provider=default|OpenAI|Anthropic|Gemini|Ollama temperature=0.2 batchSize=20 maxRows=0"
    learn = (Port("Algorithm", UNTRAINED), Port("Dataset", DATA))
    model, found = (Port("Trained model", TRAINED),), (Port("Metrics", METRICS),)
    out = [
        _module("data.dataset", "Import Dataset", "DataInput", (), _OUT, "datasetId! sampleRows=0"),
        _module("data.sql", "Import from SQL", "DataInput", (), _OUT, "provider=Sqlite|SqlServer|MySql|PostgreSql connectionString query"),
        _module("data.web", "Import from Web", "DataInput", (), _OUT, "url! format=Csv|Json headers"),
        _module("data.manual", "Enter Data", "DataInput", (), _OUT, "csv"),
        _module("tf.selectColumns", "Select Columns", "Transform", _IN, _OUT, "columns mode=keep|drop"),
        _module("tf.editMetadata", "Edit Metadata", "Transform", _IN, _OUT, "column! newName dataType"),
        _module("tf.cleanMissing", "Clean Missing Data", "Transform", _IN, _OUT, "columns strategy=mean|median|mode|constant|dropRow|dropColumn constant orderBy"),
        _module("tf.removeDuplicates", "Remove Duplicate Rows", "Transform", _IN, _OUT, "keyColumns keep=first|last orderBy"),
        _module("tf.filterRows", "Filter Rows", "Transform", _IN, _OUT, "column! op=eq|ne|gt|gte|lt|lte|contains|notEmpty value"),
        _module("tf.splitData", "Split Data", "Transform", _IN, split, "fraction=0.8 stratifyColumn randomSeed=42 idColumns"),
        _module("tf.join", "Join Data", "Transform", two, _OUT, "leftKey! rightKey! kind=inner|left|full|right|left_semi|left_anti"),
        _module("tf.groupBy", "Group By", "Transform", _IN, _OUT, "groupBy! aggregateColumn aggregate=mean|sum|min|max|count"),
        _module("tf.normalize", "Normalize Data", "Transform", _IN, _OUT, "columns method=minmax|zscore|logscale|binning bins=10"),
        _module("tf.oneHot", "Encode Categories", "Transform", _IN, _OUT, "columns! method=oneHot|ordinal|hash hashBits=10"),
        _module("tf.featurizeText", "Featurize Text", "Transform", _IN, _OUT, "column! outputColumn=TextFeatures wordGramLength=2 charGramLength=0 removeStopWords=true"),
        _module("tf.featureSelection", "Select Features", "Transform", _IN, ranked, "labelColumn! method=correlation|mutualInformation|variance topN=10"),
        _module("llm.format", "Reformat with a Model", "Llm", _IN, _OUT, f"column! outputColumn targetFormat {asked}"),
        _module("llm.cleanse", "Clean with a Model", "Llm", _IN, _OUT, f"column! outputColumn rules {asked}"),
        _module("llm.sentiment", "Label Sentiment", "Llm", _IN, _OUT, f"column! outputColumn=Sentiment includeScore=true labels=positive,neutral,negative {asked}"),
        _module("llm.classify", "Classify with a Model", "Llm", _IN, _OUT, f"column! outputColumn=Category categories! {asked}"),
        _module("llm.extract", "Extract Fields", "Llm", _IN, _OUT, f"column! fields! {asked}"),
        _module("llm.prompt", "Prompt each Row", "Llm", _IN, _OUT, f"prompt! outputColumn=LlmOutput systemPrompt {asked}"),
        _module("train.model", "Train Model", "Training", learn, model, "labelColumn! featureColumns"),
        _module("train.clustering", "Train Clustering", "Training", learn, model, "featureColumns"),
        _module("train.crossValidate", "Cross-Validate", "Training", learn, (*found, *model), "labelColumn! featureColumns folds=5"),
        _module("train.sweep", "Sweep Parameters", "Training", learn, (*model, *found), "labelColumn! mode=random|grid iterations=12 sweep!"),
        _module("train.autoML", "Automatic Search", "Training", _IN, (*model, *found), "task=Binary|Multiclass|Regression labelColumn! maxSeconds=60 validationFraction=0.2 optimize"),
        _module("score.model", "Score Model", "Evaluate", (Port("Trained model", TRAINED), Port("Dataset", DATA)), _OUT, "appendOriginal=true"),
        _module("score.evaluate", "Evaluate Model", "Evaluate", (Port("Scored dataset", DATA), Port("Second scored dataset", DATA, False)), found, "task=auto|Binary|Multiclass|Regression|Clustering|AnomalyDetection positiveClass labelColumn"),
        _module("score.featureImportance", "Feature Importance", "Evaluate", (Port("Trained model", TRAINED), Port("Dataset", DATA)), found, "permutations=5"),
        _module("script.python", "Python Script", "Script", optional, _OUT, "code! schema! keyColumns"),
        _module("script.r", "R Script", "Script", optional, _OUT, "code"),
        _module("script.csharp", "SQL Script", "Script", optional, _OUT, "code!"),
        _module("script.js", "Expression Script", "Script", optional, _OUT, "code!"),
        _module("out.saveDataset", "Save Dataset", "Output", _IN, (), "name format=Csv|Tsv|Json|Parquet"),
        _module("out.registerModel", "Register Model", "Output", (Port("Trained model", TRAINED),), (), "name! description"),
    ]
    spoken = lambda a: re.sub(r"(?<=[a-z])(?=[A-Z])", " ", a.split(".")[-1]).title()
    for a, defaults in DEFAULTS.items():
        parameters = tuple(Parameter(k, None if v is None else str(v), v is None and k != "imageFolder") for k, v in defaults.items())
        out.append(Module(a, spoken(a), "Algorithm", (), (Port("Algorithm", UNTRAINED),), parameters, TASKS[a]))
    return out


MODULES: dict[str, Module] = {m.id: m for m in _catalogue()}


def listing(category: str | None = None) -> list[dict]:
    """The modules' ids, names, ports and parameters."""
    found = [m for m in MODULES.values() if category is None or m.category == category]
    return [{"id": m.id, "name": m.name, "category": m.category, "inputs": [p.name for p in m.inputs], "outputs": [p.name for p in m.outputs], "parameters": {p.name: p.default for p in m.parameters}} for m in found]
