"""Which model architectures suit a data set: a rules table joined to data set descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# Fixed values: (group, architecture, family, reason, when to use, trainable here, priority, alternatives).
RULES = [
    ("tabular", "Gradient Boosting (XGBoost / LightGBM / CatBoost)", "tree_ensemble", "Best default for structured tabular data on most benchmarks.", "Medium/large tabular datasets with mixed numeric & categorical features.", True, 95, ["Random Forest", "Extra Trees"]),
    ("tabular", "Random Forest / Extra Trees", "tree_ensemble", "Robust, low tuning, handles non-linearities and interactions well.", "Noisy tabular data, feature interactions, when interpretability matters.", True, 88, []),
    ("tabular", "Linear / Logistic Regression", "linear", "Fast, interpretable baseline; strong when relationships are mostly linear.", "Small data, high interpretability, sparse linear patterns.", True, 75, []),
    ("tabular", "SVM (Linear / RBF Kernel)", "kernel", "Powerful for medium-sized data with clear margin structure.", "Small-to-medium datasets (<100k rows), text-like sparse inputs.", True, 70, []),
    ("tabular", "K-Nearest Neighbors (KNN)", "instance_based", "Non-parametric; good local decision boundaries.", "Small datasets, low dimensionality after encoding.", True, 60, []),
    ("tabular", "Naive Bayes", "probabilistic", "Very fast baseline; works well for high-dimensional sparse features.", "Text-like counts, simple classification baselines.", True, 58, []),
    ("tabular", "MLP — Artificial Neural Network (ANN)", "ann", "Feed-forward network; learns non-linear tabular patterns.", "Large tabular data, complex non-linear boundaries; use when tree models plateau.", True, 72, ["TabNet", "FT-Transformer"]),
    ("tabular", "Deep Tabular Transformer (FT-Transformer / TabNet)", "transformer", "State-of-art for some tabular tasks using attention over features.", "Large tabular datasets, budget for GPU training & tuning.", False, 65, ["MLP ANN", "XGBoost"]),
    ("clustering", "K-Means", "clustering", "Fast, scalable centroid clustering.", "Spherical clusters, known K.", True, 90, []),
    ("clustering", "Agglomerative / Hierarchical", "clustering", "Builds cluster hierarchy.", "Small data, unknown K.", True, 75, []),
    ("clustering", "Gaussian Mixture Model (GMM)", "clustering", "Soft clustering with probabilistic assignments.", "Overlapping clusters.", True, 70, []),
    ("clustering", "DBSCAN", "clustering", "Density-based; finds arbitrary shapes.", "Spatial data, outliers, unknown K.", True, 68, []),
    ("clustering", "Autoencoder + K-Means (Deep Clustering)", "ann", "Neural embedding then cluster.", "High-dimensional tabular/image features.", False, 60, []),
    ("text", "TF-IDF + Linear Model (LogReg / Linear SVM)", "linear", "Strong classical baseline for text classification.", "Short-to-medium text, limited data, need fast training.", True, 90, []),
    ("text", "RNN / LSTM / GRU", "rnn", "Sequence models capture word order for text.", "Sequential text, moderate data, order matters (sentiment, NER).", None, 78, ["BiLSTM + Attention"]),
    ("text", "CNN (TextCNN)", "cnn", "Convolving n-grams; fast and effective for sentence classification.", "Fixed-length text, keyword/phrase patterns matter.", None, 74, []),
    ("text", "Transformer Encoder (BERT / RoBERTa / DistilBERT)", "transformer_encoder", "Pre-trained bidirectional context; SOTA for most NLP tasks.", "Text classification, NER, QA — use when accuracy > speed.", False, 92, ["Fine-tune encoder head"]),
    ("text", "LLM Fine-tuning (LoRA / QLoRA on Llama, Mistral)", "llm", "Instruction-tuned LLMs for complex language tasks.", "Generation, summarization, complex reasoning on text.", False, 85, ["Prompt engineering", "RAG"]),
    ("text", "Encoder-Decoder (T5 / BART)", "encoder_decoder", "Seq2seq for translation, summarization, text-to-text.", "Input text → output text (not just classification).", False, 88, []),
    ("image", "CNN (ResNet / EfficientNet / MobileNet)", "cnn", "Industry standard for image classification & feature extraction.", "Image paths/arrays, object recognition, medical imaging.", None, 95, ["Transfer learning", "image_blocks"]),
    ("image", "Vision Transformer (ViT / Swin)", "transformer", "Attention-based image model; strong on large image datasets.", "Large labeled image sets, when CNNs plateau.", False, 88, []),
    ("image", "Transfer Learning + Classifier Head", "cnn", "Freeze pretrained backbone, train small head on your labels.", "Small/medium image datasets (<50k images).", False, 92, []),
    ("image", "Autoencoder / VAE (Unsupervised)", "encoder_decoder", "Learn compressed image representations.", "Anomaly detection, denoising, dimensionality reduction on images.", False, 70, []),
    ("image", "U-Net / Diffusion Models", "generative", "Segmentation and image generation.", "Segmentation masks, inpainting, synthetic image generation.", False, 75, []),
    ("time_series", "ARIMA / SARIMA", "statistical", "Classical forecasting with trend/seasonality.", "Univariate series, interpretability.", True, 85, []),
    ("time_series", "Prophet / Exponential Smoothing", "statistical", "Handles seasonality & holidays.", "Business forecasting.", False, 80, []),
    ("time_series", "RNN / LSTM / GRU", "rnn", "Learns temporal dependencies.", "Multivariate series, long sequences.", False, 78, []),
    ("time_series", "Temporal CNN (TCN)", "cnn", "Convolutions over time; parallelizable.", "Local temporal patterns.", False, 72, []),
    ("time_series", "Temporal Transformer (Informer, PatchTST)", "transformer", "Attention over time steps.", "Long-horizon forecasting.", False, 82, []),
    ("multimodal", "Early Fusion (concat tabular + text/image embeddings)", "multimodal", "Combine features from each modality into one vector.", "Tabular + text columns in same CSV.", False, 80, []),
    ("multimodal", "Late Fusion (ensemble per modality)", "multimodal", "Train separate models, combine predictions.", "Different modalities with different best algorithms.", False, 78, []),
    ("multimodal", "Cross-Modal Transformer (CLIP-style)", "transformer", "Joint embedding space for text + image.", "Image + caption, image + metadata text.", False, 85, []),
    ("multimodal", "Multimodal LLM (GPT-4V, LLaVA)", "llm", "Large models understanding text + images together.", "Complex QA over images and text.", False, 82, []),
    ("generative", "Decoder-only Transformer (GPT-style LLM)", "transformer_decoder", "Autoregressive text generation.", "Chatbots, code gen, creative writing.", False, 70, []),
    ("generative", "Encoder-Decoder (T5, BART, MarianMT)", "encoder_decoder", "Text-to-text transformation.", "Summarization, translation, data-to-text.", False, 72, []),
]
GROUP_ORDER = ["tabular", "clustering", "text", "image", "time_series", "multimodal", "generative"]


def rules_table(spark: SparkSession, sequence_models_ready: bool = True) -> DataFrame:
    rows = [(g, i, a, f, r, w, sequence_models_ready if t is None else t, p, alt)
            for i, (g, a, f, r, w, t, p, alt) in enumerate(RULES)]
    return spark.createDataFrame(
        rows, "rule_group string, rule_ord int, architecture string, family string, reason string, when_to_use string, "
              "implemented boolean, priority int, alternatives array<string>")


def applicable_groups():
    """Rule groups that apply to a descriptor (problem_type, has_text, has_image, is_multimodal)."""
    task, text = F.col("problem_type"), F.col("has_text")
    supervised = task.isin("classification", "regression")
    picks = [
        F.when(supervised, "tabular"), F.when(task == "clustering", "clustering"), F.when(supervised & text, "text"),
        F.when(F.col("has_image"), "image"), F.when(task == "time_series", "time_series"),
        F.when(F.col("is_multimodal"), "multimodal"), F.when((task == "regression") | text, "generative"),
    ]
    return F.array_compact(F.array(*picks))


def recommend_architectures(datasets: DataFrame, limit: int = 12) -> DataFrame:
    """Ranked architectures per data set: duplicates keep their best priority, the best ``limit`` stay.

    ``datasets`` has (dataset, problem_type, has_text, has_image, is_multimodal), one row per data set of a
    catalogue that may be long; the rules are a short fixed table, so the join is a broadcast on the group.
    """
    groups = datasets.select("dataset", F.explode(applicable_groups()).alias("rule_group"))
    joined = groups.join(F.broadcast(rules_table(datasets.sparkSession)), "rule_group")
    same = Window.partitionBy("dataset", "architecture").orderBy(F.col("priority").desc(), F.col("rule_ord"))
    unique = joined.withColumn("_r", F.row_number().over(same)).filter("_r = 1").drop("_r")
    order = Window.partitionBy("dataset").orderBy(F.col("priority").desc(), F.col("rule_ord"))
    return unique.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def by_family(recommendations: DataFrame) -> DataFrame:
    """Architecture names per family, best first; a data set has at most as many as there are rules."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "architecture"))), lambda s: s["architecture"])
    return recommendations.groupBy("dataset", "family").agg(names.alias("architectures"))


def top_pick(recommendations: DataFrame) -> DataFrame:
    return recommendations.filter("rank = 1").select("dataset", "architecture", "family", "reason", "priority")
