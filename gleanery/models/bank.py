"""The model banks: every name, its family, and how it is trained."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from . import linear, other, perceptron, texts, trees

# Model name to family; anything else is "other".
FAMILIES = {
    "mlp_ann": "ann",
    "xgboost": "tree_ensemble", "lightgbm": "tree_ensemble", "catboost": "tree_ensemble",
    "random_forest": "tree_ensemble", "extra_trees": "tree_ensemble", "gradient_boosting": "tree_ensemble",
    "ada_boost": "tree_ensemble", "decision_tree": "tree_ensemble",
    "linear_svc": "linear", "linear_svr": "linear", "logistic_regression": "linear", "ridge_classifier": "linear",
    "linear_regression": "linear", "ridge": "linear", "lasso": "linear", "elastic_net": "linear",
    "svm_rbf": "kernel", "svr_rbf": "kernel", "knn": "instance_based", "gaussian_nb": "probabilistic",
    "tfidf_logistic": "text_linear", "tfidf_linear_svc": "text_linear",
    "tfidf_complement_nb": "text_probabilistic", "tfidf_random_forest": "text_ensemble",
    "embed_windows": "cnn", "embed_sequence": "rnn", "image_blocks": "cnn",
}


def model_family(name: str) -> str:
    return FAMILIES.get(name, "other")


def family_column(name: Column) -> Column:
    """The same lookup for a column of model names."""
    table = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), F.lit("other"))


@dataclass(frozen=True)
class Spec:
    name: str
    train: Callable
    has_probability: bool = False

    @property
    def family(self) -> str:
        return model_family(self.name)


CLASSIFIERS = [
    Spec("logistic_regression", lambda d, c: linear.fit_logistic(d, c, 1.0), True),
    Spec("ridge_classifier", lambda d, c: linear.fit_logistic(d, c, 0.5), True),
    Spec("linear_svc", linear.fit_linear_svc),
    Spec("svm_rbf", linear.fit_svm_rbf),
    Spec("knn", lambda d, c: other.fit_knn(d, c, 7), True),
    Spec("gaussian_nb", other.fit_gaussian_nb, True),
    Spec("decision_tree", lambda d, c: trees.fit_tree(d, c, 12), True),
    Spec("random_forest", lambda d, c: trees.fit_forest(d, c, 200), True),
    Spec("extra_trees", lambda d, c: trees.fit_extra_trees(d, c, 200), True),
    Spec("gradient_boosting", lambda d, c: trees.fit_boosted(d, c, 100, 3, 0.1), True),
    Spec("ada_boost", lambda d, c: trees.fit_ada_classifier(d, c, 50), True),
    Spec("xgboost", trees.fit_xgb_style, True),
    Spec("mlp_ann", lambda d, c: perceptron.fit_mlp_classifier(d, c, (128, 64), 400), True),
    Spec("lightgbm", trees.fit_lgbm_style, True),
    Spec("catboost", trees.fit_catboost_style, True),
]

REGRESSORS = [
    Spec("linear_regression", lambda d, c: linear.fit_least_squares(d, c)),
    Spec("ridge", lambda d, c: linear.fit_least_squares(d, c, l2=1.0 / c.n)),
    Spec("lasso", lambda d, c: linear.fit_least_squares(d, c, l1=1.0)),
    Spec("elastic_net", lambda d, c: linear.fit_least_squares(d, c, l1=0.5, l2=0.5)),
    Spec("linear_svr", lambda d, c: linear.fit_linear_svr(d, c, 0.0, 1.0)),
    Spec("svr_rbf", linear.fit_svr_rbf),
    Spec("knn", lambda d, c: other.fit_knn(d, c, 7)),
    Spec("decision_tree", lambda d, c: trees.fit_tree(d, c, 12)),
    Spec("random_forest", lambda d, c: trees.fit_forest(d, c, 200)),
    Spec("extra_trees", lambda d, c: trees.fit_extra_trees(d, c, 200)),
    Spec("gradient_boosting", lambda d, c: trees.fit_boosted(d, c, 100, 3, 0.1)),
    Spec("ada_boost", lambda d, c: trees.fit_ada_regressor(d, c, 50)),
    Spec("xgboost", trees.fit_xgb_style),
    Spec("mlp_ann", lambda d, c: perceptron.fit_mlp_regressor(d, c, (128, 64), 400)),
    Spec("lightgbm", trees.fit_lgbm_style),
    Spec("catboost", trees.fit_catboost_style),
]

TEXT_CLASSIFIERS = [
    Spec("tfidf_logistic", texts.fit_tfidf_logistic, True),
    Spec("tfidf_linear_svc", texts.fit_tfidf_linear_svc),
    Spec("tfidf_complement_nb", texts.fit_tfidf_complement_nb, True),
    Spec("tfidf_random_forest", texts.fit_tfidf_random_forest, True),
]

TEXT_SEQUENCE = [
    Spec("embed_windows", texts.fit_embed_windows, True),
    Spec("embed_sequence", texts.fit_embed_sequence, True),
]

TEXT_REGRESSORS = [
    Spec("embed_windows", texts.fit_embed_windows),
    Spec("embed_sequence", texts.fit_embed_sequence),
]


def spec(bank: list[Spec], name: str) -> Spec:
    return next(s for s in bank if s.name == name)


def bank_for(problem_type: str) -> list[Spec]:
    return CLASSIFIERS if problem_type == "classification" else REGRESSORS
