"""budgetlens.operators"""
