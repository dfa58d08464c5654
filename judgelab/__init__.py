"""judgelab: evaluation analytics for language-model outputs as Spark DataFrame plans."""
