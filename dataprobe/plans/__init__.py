"""The three analyses, composed from the operators: detect a problem, try a fix, measure and explain it.

Each has a first round and a recheck.  The recheck follows a label edit and recomputes only what that edit
can reach; ``tests/test_plans.py`` compares it with computing everything again.
"""
