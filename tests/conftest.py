import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

# A small invented treebank: a multi-word range, a skippable '_' form,
# features with commas and brackets, subtyped relations, an empty node.
TINY = """# sent_id = t-1
# text = The dogs bark at the cat.
1\tThe\tthe\tDET\t_\tDefinite=Def\t2\tdet\t_\t_
2\tdogs\tdog\tNOUN\t_\tNumber=Plur\t3\tnsubj\t_\t_
3\tbark\tbark\tVERB\t_\tNumber=Plur|Person=3\t0\troot\t_\t_
4\tat\tat\tADP\t_\t_\t6\tcase\t_\t_
5\tthe\tthe\tDET\t_\tDefinite=Def\t6\tdet\t_\t_
6\tcat\tcat\tNOUN\t_\tNumber=Sing\t3\tobl\t_\tSpaceAfter=No
7\t.\t.\tPUNCT\t_\t_\t3\tpunct\t_\t_

# sent_id = t-2
# text = A dog barks del mar.
1\tA\ta\tDET\t_\tDefinite=Ind\t2\tdet\t_\t_
2\tdog\tdog\tNOUN\t_\tNumber=Sing\t3\tnsubj\t_\t_
3\tbarks\tbark\tVERB\t_\tNumber=Sing|Person=3\t0\troot\t_\t_
4-5\tdel\t_\t_\t_\t_\t_\t_\t_\t_
4\tde\tde\tADP\t_\t_\t6\tcase\t_\t_
5\tel\tel\tDET\t_\tNumber[psor]=Sing\t6\tdet\t_\t_
6\tmar\tmar\tNOUN\t_\tNumber=Sing\t3\tobl\t_\tSpaceAfter=No
7\t.\t.\tPUNCT\t_\t_\t3\tpunct\t_\t_

# sent_id = t-3
# text = Dogs were seen today
1\tDogs\tdog\tNOUN\t_\tNumber=Plur\t3\tnsubj:pass\t_\t_
2\twere\tbe\tAUX\t_\tNumber=Plur\t3\taux\t_\t_
3\tseen\tsee\tVERB\t_\tVerbForm=Part\t0\troot\t_\t_
3.1\tsaw\tsee\tVERB\t_\t_\t_\t_\t_\t_
4\t_\t_\tX\t_\t_\t3\tdep\t_\t_
5\ttoday\ttoday\tNOUN\t_\tCase=Acc,Dat\t3\tobl\t_\t_

# sent_id = t-4
# text = Cats sleep while the dog barks
1\tCats\tcat\tNOUN\t_\tNumber=Plur\t2\tnsubj\t_\t_
2\tsleep\tsleep\tVERB\t_\tNumber=Plur|Person=3\t0\troot\t_\t_
3\twhile\twhile\tSCONJ\t_\t_\t6\tmark\t_\t_
4\tthe\tthe\tDET\t_\tDefinite=Def\t5\tdet\t_\t_
5\tdog\tdog\tNOUN\t_\tNumber=Sing\t6\tnsubj\t_\t_
6\tbarks\tbark\tVERB\t_\tNumber=Sing|Person=3\t2\tadvcl\t_\t_

"""


@pytest.fixture(scope="session")
def spark():
    from minpairs.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="minpairs-tests")
    yield s


@pytest.fixture(scope="session")
def tiny_path(tmp_path_factory):
    d = tmp_path_factory.mktemp("tb")
    p = d / "tiny.conllu"
    p.write_text(TINY, encoding="utf-8")
    return str(p)


@pytest.fixture(scope="session")
def tiny(spark, tiny_path):
    from minpairs.sources.conllu import read_conllu

    return read_conllu(spark, tiny_path).persist()
