"""minpairs: minimal-pair syntactic test sets from dependency treebanks,
built and evaluated as Spark jobs.

DataFrame in, DataFrame out:

    tb   = read_conllu(spark, ["train.conllu", "dev.conllu"])      # A1-A3
    lex  = lexicon(tb.tokens)                                       # B1-B8
    pat  = Pattern(nodes={"V": {"upos": "VERB"}, "N": {"upos": "NOUN"}},
                   edges=[("V", "nsubj", "N")])                     # C1-C5
    res  = build_masked(tb.sentences, pat, "V")                     # C6-D8
    mp   = minimal_pairs(res.masked_with_context, lex, {"number": "Plur"})  # E1-E5
    sc   = token_scores(mp, fit_bigram(tb.sentences).stored())      # S8
    pair_metrics(sc)                                                # M1-M10
    with_ood_pairs(mp, 3)                                           # E6
"""

from .functions.metrics import (accuracy, avg_certainty, avg_surprisal, avg_surprisal_difference, certainty,
                                classification, entropy, norm_avg_surprisal_difference, pair_metrics, predictions,
                                round_half_even, softmax, surprisal)
from .functions.text import py_strip, starts_upper, truncate_text
from .operators.lexicon import (candidate_set, collect_feature_names, feature_names, lexicon, lookup,
                                morphological_features, wide)
from .operators.mask import build_masked, mask_check, masked_dataset, prompt_dataset
from .operators.pairs import (alternative_forms, lexicon_index, minimal_pairs, ood_picks, override_feats,
                              pair_vocabulary, with_ood_pairs)
from .operators.pattern import Pattern, match, match_in_row
from .operators.reshape import distribution, exact_quantiles, has_pair, histogram, melt_long
from .operators.score import (evaluate, evaluate_file, fit_bigram, fit_masked, ood_average, sentence_pair_scores,
                              sentence_scores, token_scores)
from .plans.tasks import Task, run_summary, task_batch
from .session import cut_lineage, local_session, tune
from .sources.conllu import read_conllu
from .sources.derived import derived_treebank
from .sources.tables import load_evaluation, load_lexicon, load_pairs, save_lexicon, save_table
from .sources.treebank import Treebank, read_treebank

__all__ = [n for n in dir() if not n.startswith("_")]
