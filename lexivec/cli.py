"""Command line: python -m lexivec.cli VERB ..."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidArgument
from .operators import metrics, neighbors, quantization, scoring, search, training
from .operators.scoring import Model
from .params import Params, loss_kind
from .sources import binary, corpus, vectors

#: Options of training by their names on the command line.
OPTIONS = {"".join(w.title() if k else w for k, w in enumerate(f.name.split("_"))): f.name for f in fields(Params) if f.name not in ("model", "label", "pretrained_vectors")}
TRAINING = ("supervised", "skipgram", "cbow")


def normalize(args: list[str]) -> list[str]:
    """Options with one dash as with two; values and "-" stay."""
    return [f"-{a}" if len(a) > 2 and a[0] == "-" and a[1].isalpha() else a for a in args]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexivec", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb in TRAINING:
        p = verbs.add_parser(verb)
        p.add_argument("--input", required=True)
        p.add_argument("--output", required=True)
        p.add_argument("--label", default="__label__")
        p.add_argument("--pretrainedVectors", default="")
        for option, name in OPTIONS.items():
            kind = {f.name: f for f in fields(Params)}[name].default
            if isinstance(kind, bool):
                p.add_argument(f"--{option}", action="store_true", default=None)
            else:
                p.add_argument(f"--{option}", type=str if name == "loss" else type(kind), default=None)
    for verb, names in {"predict": "model input k threshold", "predict-prob": "model input k threshold", "test": "model input k threshold", "test-label": "model input k threshold", "print-word-vectors": "model input", "print-sentence-vectors": "model input", "print-ngrams": "model word", "nn": "model word k", "analogies": "model a b c k", "dump": "model what", "quantize": "model input output"}.items():
        p = verbs.add_parser(verb)
        for n in names.split():
            p.add_argument(n, **({"nargs": "?", "type": int if n == "k" else float, "default": (10 if verb in ("nn", "analogies") else 1) if n == "k" else 0.0} if n in ("k", "threshold") else {"choices": ("args", "dict", "input", "output")} if n == "what" else {}))
        if verb == "quantize":
            for option, kind in (("dsub", int), ("cutoff", int), ("epoch", int), ("lr", float), ("thread", int)):
                p.add_argument(f"--{option}", type=kind, default=None)
            for option in ("qnorm", "qout", "retrain"):
                p.add_argument(f"--{option}", action="store_true")
    return top


def training_params(args: argparse.Namespace) -> Params:
    given = {name: getattr(args, option) for option, name in OPTIONS.items() if getattr(args, option) is not None}
    if "loss" in given:
        given["loss"] = loss_kind(given["loss"])
    given |= {"label": args.label, "pretrained_vectors": args.pretrainedVectors}
    return Params.supervised(**given) if args.verb == "supervised" else Params.unsupervised(args.verb, **given)


def load(spark: SparkSession, path: str) -> Model:
    found = binary.load_binary(spark, path) if path.endswith((".bin", ".ftz")) else binary.load(spark, path)
    return found.as_model() if isinstance(found, quantization.QuantizedModel) else found


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    if path == "-":
        return spark.createDataFrame([(k, line.rstrip("\n")) for k, line in enumerate(sys.stdin)], "line_id long, text string")
    return corpus.read_lines(spark, path)


def _vector(v) -> str:
    return " ".join(corpus.format_number(x, 5) for x in v)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    args = parser().parse_args(normalize(sys.argv[1:] if argv is None else argv))
    spark = spark or SparkSession.builder.appName("lexivec").getOrCreate()
    say = lambda *x: print(*x, file=out or sys.stdout)
    try:
        if args.verb in TRAINING:
            p, docs = training_params(args), corpus.read_lines(spark, args.input)
            if p.has_autotune:
                model = search.autotune(docs, corpus.read_lines(spark, p.autotune_validation_file), p, id_col="line_id").model
            else:
                given = vectors.read_vectors(spark, p.pretrained_vectors, p.dim) if p.pretrained_vectors else None
                model = training.train(docs, p, "line_id", pretrained=given)
            binary.save_binary(model, f"{args.output}.ftz" if isinstance(model, quantization.QuantizedModel) else f"{args.output}.bin")
            if isinstance(model, Model):
                vectors.write_vectors(model, f"{args.output}.vec")
            return 0
        if args.verb == "quantize":
            model = load(spark, args.model)
            given = {k: v for k, v in (("epoch", args.epoch), ("lr", args.lr), ("thread", args.thread)) if v is not None}
            q = quantization.quantize(model, args.dsub or 2, args.cutoff or 0, args.qnorm, args.qout, corpus.read_lines(spark, args.input) if args.retrain else None, **given)
            binary.save_binary(q, args.output)
            return 0
        model = load(spark, args.model)
        if args.verb in ("predict", "predict-prob"):
            docs = lines_of(spark, args.input)
            best = scoring.predict(docs, model, args.k, args.threshold, "line_id")
            said = F.concat_ws(" ", "label", F.format_string("%.6g", "prob")) if args.verb == "predict-prob" else F.col("label")
            joined = best.groupBy(F.col("line_id").alias("_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", said.alias("s")))), lambda x: x["s"]), " ").alias("text"))
            for r in docs.join(joined, F.col("line_id") == F.col("_id"), "left").orderBy("line_id").select(F.coalesce(joined["text"], F.lit(""))).toLocalIterator():
                say(r[0])
        elif args.verb in ("test", "test-label"):
            _, _, counts, n = search.evaluate(model, lines_of(spark, args.input), args.k, args.threshold, "line_id")
            if args.verb == "test-label":
                names = model.vocabulary.labels().select("label_id", F.col("token").alias("label"))
                say(metrics.label_report(metrics.per_label(counts).join(names, "label_id").orderBy("label_id").collect()))
            say(metrics.report(metrics.micro(counts, n, args.k, model.vocabulary.nlabels).first(), args.k))
        elif args.verb == "print-word-vectors":
            # each word as often and in the order in which it is read; vectors are made once for each different word
            words = lines_of(spark, args.input).select("line_id", F.posexplode(F.split("text", r"\s+")).alias("pos", "token")).where("token <> ''")
            own = scoring.word_vectors(words.select("token").distinct(), model)
            for r in words.join(own, "token").orderBy("line_id", "pos").toLocalIterator():
                say(r.token, _vector(r.vec))
        elif args.verb == "print-sentence-vectors":
            for r in scoring.sentence_vectors(lines_of(spark, args.input), model, "line_id").orderBy("line_id").toLocalIterator():
                say(_vector(r.vec))
        elif args.verb == "print-ngrams":
            for r in scoring.ngram_vectors(spark.createDataFrame([(args.word,)], "token string"), model).orderBy("pos").collect():
                say(r.gram, _vector(r.vec))
        elif args.verb in ("nn", "analogies"):
            table = neighbors.normalized(scoring.word_vectors(model.vocabulary.words().select("token"), model), "token", "vec")
            if args.verb == "nn":
                own = scoring.word_vectors(spark.createDataFrame([(args.word,)], "token string"), model)
                asked = neighbors.normalized(own, "token", "vec").select(F.col("token").alias("query"), "vec", F.array("token").alias("banned"))
            else:
                asked = neighbors.analogy_queries(spark.createDataFrame([("q", args.a, args.b, args.c)], "query string, a string, b string, c string"), table, "token")
            for r in neighbors.nearest(asked, table, args.k, "token", 1).orderBy("rank").collect():
                say(r.token, corpus.format_number(r.sim))
        else:
            for r in corpus.dump(model, args.what).toLocalIterator():
                say(r.text)
        return 0
    except InvalidArgument as error:
        print(error, file=sys.stderr)
        return 1


__all__ = ["main", "normalize", "parser"]

if __name__ == "__main__":
    sys.exit(main())
